"""Packing of texts into containers of fixed capacity.

Method: *shortest-pack-first over the length histogram*.  Only the histogram
of item lengths, at most ``capacity`` numbers, reaches the driver.  Lengths
are placed longest first: each item goes to the shortest pack, the one with the
most space left, or opens a new one.  Packs are counted by pattern (multiset of
lengths); a length splits at most one pattern and opens at most two, so there
are at most three for each length and the work depends on the capacity, never
on the number of texts.  Patterns are joined back by rank: the texts of one
length are numbered, each place of a pattern takes a range of ranks, and a
binary search over the ranges, a broadcast bounded by the capacity, finds it.

No text is split unless it alone exceeds the capacity; then full containers
are cut off it and the rest is packed like any other item.

Ranks within one length are counted per hash bucket first, so a length that
holds a third of all texts is numbered in many tasks.

Defined results: null and empty texts have no tokens and no container; exact
copies are separate items; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.session import materialize

#: Rows of one rank bucket.
BUCKET_ROWS = 50_000
#: Bits of a rank in the key of a range.
RANK_BITS = 42


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns (count, ((length, times), ...)) that place every item of the histogram.

    Lengths run from the longest; each item goes to the pack with the most
    space left, and opens a new one if it does not fit there.
    """
    left: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # space -> [(packs, lengths)]
    spaces: list[int] = []  # the spaces in use, negated, as a heap

    def put(space: int, packs: int, lengths: tuple[int, ...]) -> None:
        if space not in left:
            left[space] = []
            heapq.heappush(spaces, -space)
        left[space].append((packs, lengths))

    for length in sorted(histogram, reverse=True):
        items = histogram[length]
        while items:
            space = -spaces[0] if spaces else 0
            if space < length:
                per_pack = capacity // length
                full, rest = divmod(items, per_pack)
                if full:
                    put(capacity - per_pack * length, full, (length,) * per_pack)
                if rest:
                    put(capacity - rest * length, 1, (length,) * rest)
                break
            packs, lengths = left[space].pop()
            used = min(packs, items)
            if used < packs:
                left[space].append((packs - used, lengths))
            if not left[space]:
                del left[space]
                heapq.heappop(spaces)
            put(space - length, used, (*lengths, length))
            items -= used
    out = []
    for found in left.values():
        for packs, lengths in found:
            out.append((packs, tuple(sorted(Counter(lengths).items(), reverse=True))))
    return sorted(out, key=lambda p: (p[1], p[0]), reverse=True)


def places(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, last rank, first container): ranks of a length that fill consecutive containers."""
    nth: dict[int, int] = defaultdict(int)
    out, container = [], 0
    for packs, lengths in patterns:
        for length, times in lengths:
            for _ in range(times):
                out.append((length, nth[length], nth[length] + packs - 1, container))
                nth[length] += packs
        container += packs
    return out


def ranked(items: DataFrame, rows: int) -> DataFrame:
    """Items with ``rank``, from 0, within their length."""
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    spread = items.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = spread.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "copy")
    numbered = spread.withColumn("_at", F.row_number().over(local) - 1)
    return numbered.join(offsets, ["length", "_bucket"]).withColumn("rank", F.col("_before") + F.col("_at")).drop("_bucket", "_before", "_at")


def _place(table: Broadcast):
    """The container of each (length, rank), by binary search."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, shift = table.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_tokens", "rank"))
            at = np.searchsorted(starts, (length << RANK_BITS) + rank, side="right") - 1
            arrays = [batch.column(c) for c in ("doc_id", "piece", "n_tokens")] + [pa.array(shift[at] + rank if len(rank) else rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "n_tokens", "container"])

    return place


def pack(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_name, container, doc_id, piece, n_tokens): the container of every text for every limit.

    ``sized`` has doc_id and n_tokens; ``limits`` has pack_name and capacity (a
    handful of rows).  A text longer than the capacity has several pieces.
    """
    spark = sized.sparkSession
    # copy numbers repeated (doc_id, n_tokens) rows, so that exact repeats stay apart
    copies = W.partitionBy("doc_id").orderBy("n_tokens")
    sized = materialize(sized.where("n_tokens > 0").select("doc_id", "n_tokens", F.row_number().over(copies).alias("copy")), "sizes")
    out = None
    for name, capacity in sorted((r["pack_name"], r["capacity"]) for r in limits.where("capacity > 0").select("pack_name", "capacity").distinct().collect()):
        last = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("int")
        piece = F.explode(F.sequence(F.lit(0), last - 1)).alias("piece")
        items = sized.select("doc_id", "copy", "n_tokens", piece)
        items = items.select("doc_id", "copy", "piece", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity).alias("length"))
        histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
        taken = sorted(places(pack_histogram(histogram, capacity)))
        starts = np.array([(length << RANK_BITS) + lo for length, lo, _, _ in taken], dtype=np.int64)
        shift = np.array([base - lo for _, lo, _, base in taken], dtype=np.int64)
        table = spark.sparkContext.broadcast((starts, shift))
        numbered = ranked(items, sum(histogram.values())).select("doc_id", F.col("piece").cast("long").alias("piece"), F.col("length").alias("n_tokens"), "rank")
        found = numbered.mapInArrow(_place(table), "doc_id long, piece long, n_tokens long, container long")
        packed = found.select(F.lit(name).alias("pack_name"), "container", "doc_id", "piece", "n_tokens")
        out = packed if out is None else out.unionByName(packed)
    return out if out is not None else spark.createDataFrame([], "pack_name string, container long, doc_id long, piece long, n_tokens long")


def fill_rates(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_name, capacity, containers, tokens, fill): how full the containers are."""
    used = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("t")).groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return used.join(F.broadcast(limits.distinct()), "pack_name").select(
        "pack_name", F.col("capacity").cast("long").alias("capacity"), "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill")
    )


def faults(packed: DataFrame, sized: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_name, texts, overfull, split_needlessly, tokens_lost): what a valid packing holds; the last three are 0."""
    sizes = F.broadcast(limits.select("pack_name", F.col("capacity").cast("long").alias("capacity")).distinct())
    filled = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("t")).join(sizes, "pack_name")
    full = filled.groupBy("pack_name").agg(F.sum((F.col("t") > F.col("capacity")).cast("long")).alias("overfull"))
    texts = packed.groupBy("pack_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("placed")).join(sized, "doc_id").join(sizes, "pack_name")
    split = (F.col("pieces") > F.ceil(F.col("n_tokens") / F.col("capacity"))).cast("long")
    counted = texts.groupBy("pack_name").agg(F.count("*").alias("texts"), F.sum(split).alias("split_needlessly"), F.sum(F.abs(F.col("n_tokens") - F.col("placed"))).alias("tokens_lost"))
    return counted.join(full, "pack_name").select("pack_name", "texts", "overfull", "split_needlessly", "tokens_lost")
