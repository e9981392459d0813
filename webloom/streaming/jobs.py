"""Structured Streaming jobs over fetch events; each equals its batch operator on the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.operators.rollup import host_rollup, merge_rollups
from webloom.operators.tree import host_key

LATE = "120 seconds"
PARK_AFTER = 12


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream; the schema is that of the files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(fs.resolvePath(at)).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withColumn("ts", F.timestamp_seconds("sec")).withWatermark("ts", late)


def window_counts(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """(sec, pages, errors, bytes) per event-time window; ``sec`` is its start."""
    ok = F.col("ok")
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w")).agg(
        F.sum(ok.cast("long")).alias("pages"), F.sum((~ok).cast("long")).alias("errors"), F.sum(F.when(ok, F.col("bytes")).otherwise(0)).alias("bytes")
    ).select(F.unix_timestamp("w.start").alias("sec"), "pages", "errors", "bytes")


def seen_dedupe(events: DataFrame) -> DataFrame:
    """Events of urls not seen before in the stream (unbounded state, as the seen-set is)."""
    return events.select("url", host_key(F.col("host")).alias("host")).dropDuplicates(["url"])


def replay_dedupe(events: DataFrame) -> DataFrame:
    """Events without replays that come within the watermark."""
    return events.dropDuplicatesWithinWatermark(["seq"])


HOST_STATE = "host string, fails long, state string, last_seq long"


def _host_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fails, parked, last = state.get if state.exists else (0, False, -1)
    rows = pd.concat(list(batches)).sort_values("seq").drop_duplicates("seq")
    for seq, bad in zip(rows["seq"].tolist(), rows["bad"].tolist()):
        if seq <= last:  # a replay
            continue
        fails, last = fails + 1 if bad else 0, seq
        parked = parked or fails >= PARK_AFTER
    state.update((fails, parked, last))
    yield pd.DataFrame({"host": [key[0]], "fails": [fails], "state": ["parked" if parked else "ready"], "last_seq": [last]})


def host_states(events: DataFrame) -> DataFrame:
    """Per micro-batch the state of its hosts: consecutive failures, parked from twelve on for good; events not newer than the last are replays."""
    bad = ((F.col("status") == 0) | (F.col("status") >= 500)).alias("bad")
    narrow = events.select(host_key(F.col("host")).alias("host"), "seq", bad)
    return narrow.groupBy("host").applyInPandasWithState(_host_state, HOST_STATE, "fails long, parked boolean, last_seq long", "update", GroupStateTimeout.NoTimeout)


def rollup_sink(table: str):
    """foreachBatch sink that merges each batch's host roll-up into versioned tables ``<table>/<batch>``; replays of a batch overwrite it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = host_rollup(batch.withColumn("host", host_key(F.col("host"))).dropDuplicates(["seq"]))
        merged = merge_rollups(spark.read.parquet(f"{table}/{number - 1}"), new) if number else new
        merged.write.mode("overwrite").parquet(f"{table}/{number}")

    return write


#: State that grows with the stream is kept on the executors' disks; each batch hands on its changes, not a copy of the whole.
#: Memory outside the heap is bounded for an executor, whatever the number of its state stores.
_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """A query keeps the settings it was started with; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Process everything available into Parquet files of the shared ``folder`` and return them; no row reaches the driver."""
    spark, schema = stream.sparkSession, stream.schema
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    with _settings(spark, _ON_DISK):
        query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Process everything available into a memory table and return it."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
