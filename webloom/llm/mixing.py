"""Mixing sources to target shares of all tokens.

Method: *low-discrepancy source schedule*.  Each source's texts are shuffled
by hash and laid end to end; every ``BLOCK_TOKENS`` tokens make a block, and a
text belongs to the block that holds its middle.  The mixture is a row of slots of
one block each.  Slot ``i`` takes the golden-ratio point ``frac(i * phi)`` and
with it the source whose interval of the cumulative shares holds the point;
any stretch of slots thus has every source close to its share.  The ``r``-th
slot of a source takes its block ``r mod blocks``, so a small source comes
round again, at most ``max_repeats`` times.

The number of slots is the largest for which no source runs out: the least of
``tokens * max_repeats / share``.  Slots are generated and ranked in ranges of
``RANGE`` slots: counts per range and source are summed up front, so no window
runs over all slots of a source.

Defined results: sources without a target, targets without texts or with a
share or repeats of null or 0 take no part, and the shares of the others are
scaled to sum to 1; null and empty texts are not used; repeated rows are
separate texts; no eligible source gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.session import materialize

BLOCK_TOKENS = 512
RANGE = 4_096
#: Buckets in which a source's texts are shuffled and summed, per this many rows.
BUCKET_ROWS = 20_000
#: 1 / golden ratio, as a 53-bit fraction: slot points are exact in doubles up to 2^53 by integer arithmetic.
PHI = 0.6180339887498949


def blocks(sized: DataFrame, rows: int) -> DataFrame:
    """(source, doc_id, n_tokens, block): texts in shuffled order cut into equal-token blocks.

    Two-level running sum: totals of hash buckets first, then within a bucket.
    """
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    spread = sized.withColumn("_h", F.xxhash64("doc_id", "source")).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    totals = spread.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_t"))
    before = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("source", "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    local = W.partitionBy("source", "_b").orderBy("_h", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    begins = F.coalesce(F.sum("n_tokens").over(local), F.lit(0))
    placed = spread.withColumn("_begin", begins).join(offsets, ["source", "_b"])
    return placed.select("source", "doc_id", "n_tokens", F.floor((F.col("_off") + F.col("_begin") + F.col("n_tokens") / 2) / BLOCK_TOKENS).alias("block"))


def schedule(spark, shares: list[tuple[str, float]], slots: int) -> DataFrame:
    """(source, slot, nth): the source of every slot and the slot's number, from 0, within its source."""
    bounds, total = [], 0.0
    for source, share in shares:
        total += share
        bounds.append((source, total))
    i = F.col("slot").cast("decimal(20,0)") * F.lit(PHI).cast("decimal(17,16)")
    point = (i - F.floor(i)).cast("double")
    pick = F.lit(bounds[-1][0])
    for source, upper in reversed(bounds[:-1]):
        pick = F.when(point < upper, F.lit(source)).otherwise(pick)
    drawn = spark.range(slots).select(F.col("id").alias("slot")).withColumn("source", pick).withColumn("_r", F.floor(F.col("slot") / RANGE))
    counts = drawn.groupBy("source", "_r").agg(F.count("*").alias("_n"))
    before = W.partitionBy("source").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("source", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = W.partitionBy("source", "_r").orderBy("slot")
    return drawn.withColumn("_at", F.row_number().over(local) - 1).join(offsets, ["source", "_r"]).select("source", "slot", (F.col("_off") + F.col("_at")).alias("nth"))


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, doc_id, repeat, slot, n_tokens): the mixture, one row for each use of a text.

    With ``total_tokens`` the mixture is that large even if sources run out
    (they fall short of their shares); without, as large as all shares allow.
    """
    spark = sized.sparkSession
    sized = materialize(sized.where("n_tokens > 0 and source is not null").select("source", "doc_id", "n_tokens"), "mix-sizes")
    wanted = targets.where("target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("times"))
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    plan = [r.asDict() for r in sizes.join(wanted, "source").collect()]  # one row per source
    if not plan:
        return spark.createDataFrame([], "source string, doc_id long, repeat long, slot long, n_tokens long")
    plan.sort(key=lambda r: r["source"])
    scale = sum(r["share"] for r in plan)
    per_source = {r["source"]: max(1, math.ceil(r["tokens"] / BLOCK_TOKENS)) for r in plan}
    most = total_tokens or min(r["tokens"] * r["times"] / (r["share"] / scale) for r in plan)
    slots = max(1, math.floor(most / BLOCK_TOKENS))
    cut = blocks(sized.join(F.broadcast(wanted.select("source")), "source"), sum(r["rows"] for r in plan))
    n_blocks = spark.createDataFrame([(s, n) for s, n in per_source.items()], "source string, n_blocks long")
    times = spark.createDataFrame([(r["source"], r["times"]) for r in plan], "source string, times long")
    order = schedule(spark, [(r["source"], r["share"] / scale) for r in plan], slots).join(F.broadcast(n_blocks), "source").join(F.broadcast(times), "source")
    used = order.select("source", "slot", F.pmod("nth", "n_blocks").alias("block"), F.floor(F.col("nth") / F.col("n_blocks")).alias("repeat"), "times").where("repeat < times")
    return cut.join(used, ["source", "block"]).select("source", "doc_id", F.col("repeat").cast("long").alias("repeat"), "slot", "n_tokens")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, tokens, uses, most_repeats): what the mixture reached."""
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), (F.max("repeat") + 1).alias("most_repeats"))
    everything = used.agg(F.sum("tokens").alias("_all"))
    named = targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
    return named.join(used, "source", "left").crossJoin(F.broadcast(everything)).select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
