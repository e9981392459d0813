"""Frontier: seen-set joins, crawl order, leases, politeness and recrawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.functions.url import key_host

PENDING, DONE, DEAD = 0, 1, 2
LAST_PRIORITY = 255


def enqueue(candidates: DataFrame, url_state: DataFrame) -> DataFrame:
    """Candidates whose url is not blank and was never seen, one row per url (least depth)."""
    fresh = candidates.where(F.coalesce("url", F.lit("")) != "").groupBy("url").agg(F.min("depth").alias("depth"))
    new = fresh.join(url_state.select("url"), "url", "left_anti")
    return new.select("url", key_host(F.col("url")).alias("host"), "depth")


def priority(depth: Column) -> Column:
    return F.when((depth < 0) | (depth >= LAST_PRIORITY), LAST_PRIORITY).otherwise(depth).cast("int")


def shuffle_rank(url: Column) -> Column:
    """16-bit hash that breaks up runs of one host, the same on every engine."""
    return F.conv(F.substring(F.md5(url), 1, 4), 16, 10).cast("int")


def with_order(items: DataFrame) -> DataFrame:
    """Adds pri and rnd; ascending (pri, rnd, url) is the crawl order."""
    return items.withColumn("pri", priority(F.col("depth"))).withColumn("rnd", shuffle_rank(F.col("url")))


def lease(items: DataFrame, n: int) -> DataFrame:
    """The first ``n`` items in crawl order, with lease numbers from 1."""
    first = with_order(items).orderBy("pri", "rnd", "url").limit(n)
    return first.withColumn("lease", F.row_number().over(W.orderBy("pri", "rnd", "url")).cast("long"))


def refill_target(workers: int, buffered: int) -> int:
    return max(0, min(max(workers * 64, 4000), 60_000) - buffered)


def round_robin(items: DataFrame, per_host: int) -> DataFrame:
    """The first ``per_host`` items of every host with their turn; order by (turn, host) is the dispatch order."""
    w = W.partitionBy("host").orderBy("pri", "rnd", "url")
    return with_order(items).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_host)


def host_delay_ms(base: Column, crawl_delay: Column, fails: Column) -> Column:
    """Largest of the set delay, the site's crawl delay and 2^min(fails, 6) seconds."""
    backoff = F.when(fails > 0, F.pow(F.lit(2.0), F.least(fails, F.lit(6))) * 1000).otherwise(0.0)
    return F.greatest(base.cast("double"), crawl_delay * 1000.0, backoff)


def politeness(items: DataFrame, delay_ms: int, per_host: int) -> DataFrame:
    """Earliest start of each leased item: one request a ``delay_ms`` per host."""
    return round_robin(items, per_host).select("url", "host", "turn", ((F.col("turn") - 1) * delay_ms).cast("long").alias("start_ms"))


def fail_streaks(events: DataFrame) -> DataFrame:
    """(seq, host, streak): consecutive failures (no response or status from 500 on) up to each event.

    Gaps and islands within a host and day bucket would break streaks, so the
    running count of successes is taken in two levels: per block of 4096
    sequence numbers, then within the block; a hot host is many blocks.
    """
    block = 4096
    bad = (F.col("status") == 0) | (F.col("status") >= 500)
    e = events.select("seq", "host", bad.alias("bad"), F.floor(F.col("seq") / block).alias("blk"))
    inner = W.partitionBy("host", "blk").orderBy("seq")
    e = e.withColumn("_ok", F.sum((~F.col("bad")).cast("long")).over(inner)).withColumn("_n", F.row_number().over(inner))
    e = e.withColumn("_since", F.sum(F.col("bad").cast("long")).over(W.partitionBy("host", "blk", "_ok").orderBy("seq")))
    per = e.groupBy("host", "blk").agg(F.max("_ok").alias("oks"), F.count("*").alias("n"), F.max_by("_since", "seq").alias("tail"))
    outer = W.partitionBy("host").orderBy("blk")
    per = per.withColumn("_run", F.sum((F.col("oks") > 0).cast("long")).over(outer.rowsBetween(W.unboundedPreceding, -1)))
    per = per.withColumn("_run", F.coalesce("_run", F.lit(0)))
    last_ok = F.last(F.when(F.col("oks") > 0, F.col("tail")), True).over(outer.rowsBetween(W.unboundedPreceding, -1))
    whole = F.sum(F.when(F.col("oks") == 0, F.col("n")).otherwise(0)).over(W.partitionBy("host", "_run").orderBy("blk").rowsBetween(W.unboundedPreceding, -1))
    carry = per.select("host", "blk", (F.coalesce(last_ok, F.lit(0)) + F.coalesce(whole, F.lit(0))).alias("_carry"))
    joined = e.join(carry, ["host", "blk"])
    streak = F.when(~F.col("bad"), 0).when(F.col("_ok") == 0, F.col("_since") + F.col("_carry")).otherwise(F.col("_since"))
    return joined.select("seq", "host", streak.cast("long").alias("streak"))


def recrawl_due(url_state: DataFrame, cutoff: int, n: int) -> DataFrame:
    """Done urls older than the cutoff, oldest first; depth starts again at 0."""
    due = url_state.where((F.col("state") == DONE) & (F.col("done_at") < cutoff)).orderBy("done_at", "url").limit(n)
    return due.select("url", key_host(F.col("url")).alias("host"), F.lit(0).alias("depth"), "done_at")


def recrawl_policy(waiting: int, recrawl_after_hours: int, now: int) -> tuple[int, int] | None:
    """(cutoff, batch) of the next recrawl, None if enough is waiting."""
    if waiting > 200_000:
        return None
    hours, batch = (min(1, recrawl_after_hours), 20_000) if waiting < 2000 else (recrawl_after_hours, 5000)
    return now - hours * 3600, batch


def requeue(frontier: DataFrame, items: DataFrame) -> DataFrame:
    """Items put back behind everything else."""
    back = with_order(items).withColumn("pri", F.lit(LAST_PRIORITY))
    return with_order(frontier).unionByName(back.select(with_order(frontier).columns))


def ordered_union(parts: list[DataFrame], budget: int | None = None) -> DataFrame:
    """Urls of several sources in order, first occurrence kept, at most ``budget``."""
    out = None
    for i, part in enumerate(parts):
        one = part.select("url", "pos").withColumn("src", F.lit(i))
        out = one if out is None else out.unionByName(one)
    first = out.groupBy("url").agg(F.min(F.struct("src", "pos")).alias("at")).select("url", "at.src", "at.pos")
    return first.orderBy("src", "pos", "url").limit(budget) if budget is not None else first


def complete(results: DataFrame, url_state: DataFrame) -> DataFrame:
    """Seen-set after a batch of results (url, state, done_at): results replace older states."""
    last = results.groupBy("url").agg(F.max_by("state", "done_at").alias("state"), F.max("done_at").alias("done_at"))
    return url_state.join(last.select("url"), "url", "left_anti").select("url", "state", "done_at").unionByName(last.select("url", "state", "done_at"))


def daily_cap(events: DataFrame, cap: int) -> DataFrame:
    """Hosts and days with more than ``cap`` fetches, and by how many."""
    day = F.floor(F.col("sec") / 86_400).alias("day")
    return events.groupBy("host", day).agg(F.count("*").alias("n")).where(F.col("n") > cap).withColumn("over", F.col("n") - cap)
