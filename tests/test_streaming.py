"""Streams equal their batch operators."""

from pyspark.sql import functions as F

from tests.test_operators import log
from webloom.operators.rollup import host_rollup
from webloom.streaming import jobs


def _write(spark, tmp_path, rows, parts=3):
    path = str(tmp_path / "events")
    for i in range(parts):
        log(spark, rows[i::parts]).write.mode("append").parquet(path)
    return path


def test_windows_and_seen(spark, tmp_path):
    rows = [dict(seq=i, sec=i * 7, url=f"http://a.example/{i % 5}", ok=i % 3 > 0) for i in range(60)]
    path = _write(spark, tmp_path, rows)
    stream = jobs.window_counts(jobs.timed(jobs.read_stream(spark, path)), "1 minute")
    got = {r["sec"]: (r["pages"], r["errors"]) for r in jobs.run_to_memory(stream, "t_minutes", "complete").collect()}
    want: dict = {}
    for r in rows:
        a, b = want.get(r["sec"] - r["sec"] % 60, (0, 0))
        want[r["sec"] - r["sec"] % 60] = (a + r["ok"], b + (not r["ok"]))
    assert got == want
    assert jobs.run_to_memory(jobs.seen_dedupe(jobs.read_stream(spark, path)), "t_seen", "append").count() == 5


def test_host_state(spark, tmp_path):
    rows = [dict(seq=i, host="h", status=500) for i in range(12)] + [dict(seq=20, host="h", status=200), dict(seq=21, host="g", status=500)]
    path = _write(spark, tmp_path, rows, parts=1)
    got = jobs.run_to_memory(jobs.host_states(jobs.read_stream(spark, path)), "t_hosts", "update")
    last = {r["host"]: (r["fails"], r["state"]) for r in got.collect()}
    assert last == {"h": (0, "parked"), "g": (1, "ready")}


def test_rollup_sink(spark, tmp_path):
    rows = [dict(seq=i, sec=i, host="H." if i % 2 else "h") for i in range(10)]
    path = _write(spark, tmp_path, rows)
    table = str(tmp_path / "table")
    writer = jobs.read_stream(spark, path, 1).writeStream.foreachBatch(jobs.rollup_sink(table)).option("checkpointLocation", str(tmp_path / "ck"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{table}/{query.lastProgress['batchId']}").first()
    whole = host_rollup(spark.read.parquet(path).withColumn("host", F.lit("h"))).first()
    assert (last["pages"], last["first_seen"], last["last_seen"]) == (whole["pages"], 0, 9)
