"""Streaming queries: each runs over the whole table and is compared with its batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.plans.base import HOST, query
from webloom.session import scratch_dir
from webloom.streaming import jobs


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return jobs.read_stream(spark, f"{d}/fetch_log.parquet")


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """Result rows through a file sink in the shared folder (append) or the memory sink (complete, update)."""
    name = "s_" + uuid.uuid4().hex
    if mode == "append":
        return jobs.run_to_files(stream, f"{scratch_dir(stream.sparkSession).rstrip('/')}/{name}")
    return jobs.run_to_memory(stream, name, mode)


_COUNTS = "sum(ok::INT)::BIGINT AS pages, sum((NOT ok)::INT)::BIGINT AS errors, sum(CASE WHEN ok THEN bytes ELSE 0 END)::BIGINT AS bytes"


@query("stream_minute_counts", f"SELECT sec - sec % 60 AS sec, {_COUNTS} FROM fetch_log GROUP BY 1")
def stream_minute_counts(spark: SparkSession, d: str) -> DataFrame:
    return _run(jobs.window_counts(jobs.timed(_stream(spark, d)), "1 minute"), "complete")


@query("stream_second_counts", f"SELECT sec, {_COUNTS} FROM fetch_log GROUP BY 1")
def stream_second_counts(spark: SparkSession, d: str) -> DataFrame:
    return _run(jobs.window_counts(jobs.timed(_stream(spark, d)), "1 second"), "complete")


@query("stream_sliding_counts", f"SELECT w AS sec, {_COUNTS} FROM (SELECT *, unnest(range(sec - sec % 60 - 540, sec - sec % 60 + 60, 60)) AS w FROM fetch_log) GROUP BY 1")
def stream_sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return _run(jobs.window_counts(jobs.timed(_stream(spark, d)), "10 minutes", "1 minute"), "complete")


@query("stream_seen_dedup", "SELECT DISTINCT url FROM fetch_log")
def stream_seen_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _run(jobs.seen_dedupe(_stream(spark, d)), "append").select("url")


_LAST_GOOD = f"SELECT {HOST} AS host, seq, (status = 0 OR status >= 500) AS bad FROM fetch_log"


@query(
    "stream_host_state",
    f"""WITH e AS ({_LAST_GOOD}), r AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY host ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT host, seq, bool_or(bad) AS bad FROM e GROUP BY 1, 2)),
n AS (SELECT host, run, count(*) FILTER (WHERE bad) AS fails FROM r GROUP BY 1, 2)
SELECT host, max_by(fails, run)::BIGINT AS fails, CASE WHEN max(fails) >= {jobs.PARK_AFTER} THEN 'parked' ELSE 'ready' END AS state FROM n GROUP BY 1""",
)
def stream_host_state(spark: SparkSession, d: str) -> DataFrame:
    """The last state of every host; replays of an event are dropped in the stream."""
    return _run(jobs.host_states(_stream(spark, d)), "update").groupBy("host").agg(F.max_by("fails", "last_seq").alias("fails"), F.max_by("state", "last_seq").alias("state"))


@query("stream_rollup_sink")
def stream_rollup_sink(spark: SparkSession, d: str) -> DataFrame:
    """Host roll-up kept by a foreachBatch sink; the last version is the roll-up of the whole stream."""
    at = f"{scratch_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}"
    writer = _stream(spark, d).writeStream.foreachBatch(jobs.rollup_sink(f"{at}/table")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    running = writer.start()
    running.awaitTermination()
    last = running.lastProgress["batchId"] if running.lastProgress else 0
    return spark.read.parquet(f"{at}/table/{last}").select("host", "pages", "errors", F.col("bytes"))
