"""The crawl as a whole on small tables."""

import pytest
from pyspark.sql import functions as F

from tests.test_operators import log
from webloom import api
from webloom.operators.search import SearchParams

DOCS = "seq long, url string, host string, title string, description string, body string, category string, lang string, depth int, fetched_at long"


@pytest.fixture()
def store(spark):
    e = lambda s: api.empty(spark, s)
    events = log(spark, [dict(seq=1, sec=100), dict(seq=1, sec=100), dict(seq=2, sec=130, ok=False, status=500, host="B.example.")])
    return api.Store(events, e(DOCS), e(api.URL_STATE), e(api.FRONTIER), e(api.FRONTIER), e(api.FINGERPRINTS), e(api.ROBOTS))


def test_seeds_leases_and_completion(spark, store):
    s, added, given = api.add_seeds(store, ["a.example/1", "a.example/1", " ", "http://b.example/"])
    assert (added, given) == (2, 4) and api.queue_size(s, 1) == (1, False) and api.queue_size(s, 9) == (2, True)
    assert api.add_seeds(s, ["a.example/1"])[1] == 0
    s, leased = api.take(s, 1)
    assert leased.count() == 1 and s.queue.count() == 1 and api.sweep(s).queue.count() == 2
    url = leased.first()["url"]
    text = "the ferry council met on monday to discuss the timetable of the island and its harbours " * 4
    doc = f"named_struct('seq', 1L, 'url', '{url}', 'host', 'a.example', 'title', 't', 'description', '', 'body', '{text}', 'category', 'news', 'lang', 'en', 'depth', 0, 'fetched_at', 5L)"
    result = spark.range(1).selectExpr(f"'{url}' url", "1 state", "500L done_at", "false retry", "0 depth", f"array('http://c.example/', 'http://c.example/', '{url}') links", f"{doc} doc")
    s = api.complete(s, result)
    assert s.leased.count() == 0 and s.docs.count() == 1 and s.fingerprints.count() == 1
    assert {r["url"] for r in s.queue.collect()} >= {"http://c.example/"} and s.queue.where(F.col("url") == url).count() == 0
    copy = result.withColumn("url", F.lit("http://d.example/")).withColumn("doc", F.expr("named_struct('seq', 2L, 'url', 'http://d.example/', 'host', 'd.example', 'title', 't', 'description', '', 'body', doc.body, 'category', 'news', 'lang', 'en', 'depth', 0, 'fetched_at', 6L)"))
    again = api.complete(s, copy)
    assert again.docs.count() == 1
    assert [r["seq"] for r in api.find(s, SearchParams("ferry")).hits.collect()] == [1]
    assert api.top_up(s, 10**9).queue.where(F.col("url") == url).count() == 1
    assert api.control(s, "clear-queue").queue.count() == 0 and api.control(s, "clear-seen").fingerprints.count() == 1


def test_reading(store):
    values = {r["k"]: r["v"] for r in api.stats(store, 131).collect()}
    assert values["fetches"] == 2 and values["hosts"] == 2 and values["pages_per_min"] == 1 and values["success_permille"] == 500
    panels = api.snapshot(store, 131)
    assert panels["minutes"].count() == 60 and panels["hosts"].first()["host"] == "a.example"
    assert [r["before"] for r in api.pings(store).orderBy("seq").collect()] == [None, "a.example"]
    assert [r["seq"] for r in api.fresh_events(store, 1).collect()] == [2] and api.health(store)["running"] is False


def test_pages_and_discovery(spark, store):
    fetched = spark.createDataFrame([("u", 200, "text/html", "abcdef"), ("v", 200, "image/png", "x"), ("w", 404, "text/html", "y")], "url string, status int, content_type string, body string")
    assert {r["url"]: (r["body"], r["truncated"]) for r in api.pages(fetched, 4).collect()} == {"u": ("abcd", True), "v": (None, False), "w": (None, False)}
    a = spark.createDataFrame([("http://x.example/", 0), ("http://y.example/", 1)], "url string, pos int")
    b = spark.createDataFrame([("http://y.example/", 0), ("http://z.example/", 1)], "url string, pos int")
    s, n = api.discover(store, [a, b])
    assert n == 3 and s.queue.count() == 3
    assert api.discovery_due(store.config, 0, 1800) and not api.discovery_due(store.config, 0, 10) and api.discovery_due(store.config, 0, 10, forced=True)


@pytest.mark.parametrize("action", ["start", "stop", "pause", "resume", "clear-queue", "clear-robots", "reset-stats", "forget-duplicates", "reseed"])
def test_actions(store, action):
    assert api.control(store, action).url_state.count() == 0


def test_unknown_action(store):
    with pytest.raises(ValueError):
        api.control(store, "explode")


def test_alert_messages(spark):
    sent = spark.createDataFrame([(5, "disk"), (1, "stall")], "ts long, kind string")
    assert [m["kind"] for m in api.alert_messages(sent)] == ["stall", "disk"]
