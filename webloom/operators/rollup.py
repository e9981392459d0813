"""Roll-ups, counters and time series of fetch events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.operators.tree import host_key


def distinct_events(log: DataFrame) -> DataFrame:
    """Events without replays (equal rows of the same ``seq``), hosts in one spelling."""
    return log.withColumn("host", host_key(F.col("host"))).dropDuplicates(["seq"])


def last_label(label: str, order: Column) -> Column:
    """The last non-blank label, '' if there is none."""
    filled = F.when(F.trim(F.coalesce(F.col(label), F.lit(""))) != "", F.col(label))
    return F.coalesce(F.max_by(filled, F.when(filled.isNotNull(), order)), F.lit(""))


def host_rollup(events: DataFrame) -> DataFrame:
    """Per host: ok pages, errors, bytes of ok pages, last category, first and last second."""
    ok = F.col("ok")
    return events.groupBy("host").agg(
        F.sum(ok.cast("long")).alias("pages"), F.sum((~ok).cast("long")).alias("errors"), F.sum(F.when(ok, F.col("bytes")).otherwise(0)).alias("bytes"),
        last_label("category", F.col("seq")).alias("category"), F.min("sec").alias("first_seen"), F.max("sec").alias("last_seen"),
    )


def merge_rollups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sum of two host roll-ups; the newer non-blank category wins."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return both.groupBy("host").agg(
        F.sum("pages").alias("pages"), F.sum("errors").alias("errors"), F.sum("bytes").alias("bytes"),
        last_label("category", F.col("_age")).alias("category"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def label_counts(events: DataFrame, label: str) -> DataFrame:
    """Ok pages per non-blank label."""
    return events.where(F.col("ok") & (F.trim(F.coalesce(F.col(label), F.lit(""))) != "")).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def status_counts(events: DataFrame) -> DataFrame:
    return events.where("status > 0").groupBy(F.col("status").cast("long").alias("status")).agg(F.count("*").alias("n"))


def status_buckets(events: DataFrame) -> DataFrame:
    s = F.col("status")
    bucket = F.when(s.between(200, 299), "2xx").when(s.between(300, 399), "3xx").when(s.between(400, 499), "4xx").otherwise("5xx")
    return events.where(s > 0).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def totals(events: DataFrame) -> DataFrame:
    """(k, v): pages, bytes, errors, links, fetches."""
    ok = F.col("ok")
    one = events.agg(
        F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("pages"), F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum((~ok).cast("long")), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.when(ok, F.col("links"))), F.lit(0)).cast("long").alias("links"),
        F.count("*").alias("fetches"),
    )
    names = ("pages", "bytes", "errors", "links", "fetches")
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in names))).alias("x")).select("x.*")


def series(events: DataFrame, seconds: int) -> DataFrame:
    """(ts, pages, bytes, errors) per ``seconds``."""
    ok = F.col("ok")
    return events.groupBy((F.col("sec") - F.pmod("sec", F.lit(seconds))).alias("ts")).agg(
        F.sum(ok.cast("long")).alias("pages"), F.sum(F.when(ok, F.col("bytes")).otherwise(0)).alias("bytes"), F.sum((~ok).cast("long")).alias("errors")
    )


def second_slots(events: DataFrame) -> DataFrame:
    """(sec, pages, errors, bytes, latency, lat_n): latency of ok pages that have one."""
    ok = F.col("ok")
    timed = ok & F.col("latency").isNotNull()
    return events.groupBy("sec").agg(
        F.sum(ok.cast("long")).alias("pages"), F.sum((~ok).cast("long")).alias("errors"), F.sum(F.when(ok, F.col("bytes")).otherwise(0)).alias("bytes"),
        F.sum(F.when(timed, F.col("latency")).otherwise(0)).cast("long").alias("latency"), F.sum(timed.cast("long")).alias("lat_n"),
    )


def fill_grid(points: DataFrame, first: int, last: int, step: int, values: list[str]) -> DataFrame:
    """One row for every step from ``first`` to ``last``; missing values are 0."""
    spark = points.sparkSession
    grid = spark.range(first, last + 1, step).select(F.col("id").alias("ts"))
    return grid.join(points, "ts", "left").select("ts", *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def rolling_rates(slots: DataFrame, fast: int = 10) -> DataFrame:
    """Rates at every second with events, the second itself excluded.

    One window over seconds: a second is one row, so the window's single
    partition holds at most 86 400 rows a day whatever the traffic; days are
    separate partitions with the minute before them carried in.
    """
    fast = fast if 1 <= fast <= 120 else 10
    day = 86_400
    own = slots.withColumn("_day", F.floor(F.col("sec") / day)).withColumn("_own", F.lit(True))
    carried = slots.where(F.pmod("sec", F.lit(day)) >= day - 120).withColumn("_day", F.floor(F.col("sec") / day) + 1).withColumn("_own", F.lit(False))
    w = W.partitionBy("_day").orderBy("sec")
    quick, minute = w.rangeBetween(-fast, -1), w.rangeBetween(-60, -1)
    total = lambda c, win: F.coalesce(F.sum(c).over(win), F.lit(0))
    pages, errors = total("pages", minute), total("errors", minute)
    out = own.unionByName(carried).select(
        "sec", "_own", (total("pages", quick) / fast).alias("pages_per_sec"), (total("errors", quick) / fast).alias("errors_per_sec"),
        (total("bytes", quick) / fast).alias("bytes_per_sec"), pages.alias("pages_per_min"),
        F.coalesce(F.try_divide(total("latency", minute), total("lat_n", minute)), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.try_divide(pages, pages + errors), F.lit(0.0)).alias("success_rate"),
    )
    return out.where("_own").drop("_own")


def recent(events: DataFrame, n: int = 60) -> DataFrame:
    """The ``n`` newest events (1 to 400, else 60)."""
    return events.orderBy(F.desc("seq")).limit(n if 1 <= n <= 400 else 60)


def share_of_peak(counts: DataFrame) -> DataFrame:
    """Counts with their share of the largest; one row a label."""
    peak = counts.agg(F.max("n").alias("_max"))
    return counts.join(F.broadcast(peak)).select("label", "n", (F.col("n") / F.col("_max")).alias("share"))


def prune(points: DataFrame, now: int, keep_days: int) -> DataFrame:
    return points.where(F.col("ts") >= now - keep_days * 86_400)
