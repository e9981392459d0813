"""The seen-set as a stream: its rows go to files, its state to disk, and the session keeps its settings."""

from webloom.plans import registry
from webloom.streaming import jobs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def test_seen_urls_never_pass_the_driver(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "fetch_log.parquet")
    rows = [(f"http://h{i % 3}.example/{i % 40}", f"h{i % 3}.example") for i in range(200)]
    for i in range(6):
        spark.createDataFrame(rows[i::6], "url string, host string").coalesce(1).write.mode("append").parquet(path)
    monkeypatch.setattr(jobs, "run_to_memory", None)
    before = spark.conf.get(PROVIDER, None)
    got = registry.QUERIES["stream_seen_dedup"](spark, str(tmp_path))
    assert spark.conf.get(PROVIDER, None) == before
    assert sorted(r["url"] for r in got.collect()) == sorted({u for u, _ in rows})
    assert "Parquet" in got._jdf.queryExecution().executedPlan().toString()


def test_files_of_an_empty_stream(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.createDataFrame([], "url string, host string").coalesce(1).write.parquet(path)
    got = jobs.run_to_files(jobs.seen_dedupe(jobs.read_stream(spark, path)), str(tmp_path / "out"))
    assert got.columns == ["url", "host"] and got.count() == 0


def test_state_is_kept_on_disk(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.createDataFrame([("http://a.example/", "a.example")], "url string, host string").coalesce(1).write.parquet(path)
    assert jobs.run_to_files(jobs.seen_dedupe(jobs.read_stream(spark, path)), str(tmp_path / "out")).count() == 1
    assert list((tmp_path / "out" / "state" / "state").rglob("*.changelog")) or list((tmp_path / "out" / "state" / "state").rglob("*.zip"))
