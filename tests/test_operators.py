"""Operators against golden cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.functions.hashing import fingerprint_text
from webloom.operators import alerts, dedup, frontier, geo, outcome, rollup, search, tree
from webloom.sources import readers

LOG = "seq long, sec long, url string, host string, status int, ok boolean, bytes long, latency int, depth int, links int, category string, lang string, country string, err string"


def log(spark, rows):
    base = dict(seq=0, sec=0, url="http://a.example/", host="a.example", status=200, ok=True, bytes=10, latency=100, depth=0, links=1, category="news", lang="en", country="DE", err=None)
    names = [f.split()[0] for f in LOG.split(", ")]
    return spark.createDataFrame([tuple((base | {"seq": i} | r)[n] for n in names) for i, r in enumerate(rows)], LOG)


def test_rollup(spark):
    ev = log(spark, [{}, dict(status=404, ok=False, category=None), dict(status=503, ok=False, category=" "), dict(status=0, ok=False, category="")])
    row = rollup.host_rollup(ev).first()
    assert (row["pages"], row["bytes"], row["errors"], row["category"]) == (1, 10, 3, "news")
    assert {r["k"]: r["v"] for r in rollup.totals(ev).collect()}["fetches"] == 4
    assert {r["status"]: r["n"] for r in rollup.status_counts(ev).collect()} == {200: 1, 404: 1, 503: 1}


def test_replays_and_spellings(spark):
    ev = rollup.distinct_events(log(spark, [dict(seq=1, host="A.example."), dict(seq=1, host="A.example."), dict(seq=2, host="a.EXAMPLE"), dict(seq=3, host=None)]))
    assert {r["host"]: r["n"] for r in ev.groupBy("host").agg(F.count("*").alias("n")).collect()} == {"a.example": 2, "": 1}


def test_status_buckets(spark):
    ev = log(spark, [dict(status=s) for s in [200] * 5 + [301, 404, 404, 503, 100]])
    assert {r["bucket"]: r["n"] for r in rollup.status_buckets(ev).collect()} == {"2xx": 5, "3xx": 1, "4xx": 2, "5xx": 2}


def test_rates(spark):
    rows = []
    for sec, ok, bad in ((100, 9, 0), (99, 3, 0), (90, 1, 1), (89, 0, 2), (40, 1, 0), (39, 5, 0)):
        rows += [dict(sec=sec)] * ok + [dict(sec=sec, ok=False)] * bad
    row = rollup.rolling_rates(rollup.second_slots(log(spark, rows))).where("sec = 100").first()
    assert (row["pages_per_sec"], row["errors_per_sec"], row["bytes_per_sec"], row["pages_per_min"]) == (0.4, 0.1, 4.0, 5)
    assert (row["avg_latency_ms"], row["success_rate"]) == (100, 0.625)


def test_rates_across_midnight(spark):
    day = 86_400
    row = rollup.rolling_rates(rollup.second_slots(log(spark, [dict(sec=day - 5), dict(sec=day + 2)]))).where(f"sec = {day + 2}").first()
    assert row["pages_per_min"] == 1


def test_series_grid(spark):
    points = spark.createDataFrame([(120, 2), (240, 5)], "ts long, pages long")
    got = [(r["ts"], r["pages"]) for r in rollup.fill_grid(points, 60, 240, 60, ["pages"]).orderBy("ts").collect()]
    assert got == [(60, 0), (120, 2), (180, 0), (240, 5)]


@pytest.mark.parametrize("rows", [0, 10, 200_000])
def test_tree_aggregate_equals_group_by(spark, rows):
    random.seed(1)
    data = [(("hot" if random.random() < 0.6 else f"h{random.randrange(9)}"), i, random.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    got = tree.tree_aggregate(df, ["k"], ["i"], {"s": F.sum("v"), "n": F.count("*"), "m": F.max("v")}, {"s": "sum", "n": "sum", "m": "max"}, rows * 100)
    want = df.groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.max("v").alias("m"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_host_totals_edge_cases(spark):
    schema = "batch long, host string, site string, pages long, errors long, bytes long, category string, first_seen long, last_seen long, extra string"
    rows = [(1, "A.b.", None, 5, 0, 10, None, 3, 9, "x"), (1, "a.b", None, 5, 0, 10, None, 3, 9, "y"), (2, "a.b", "", None, 1, None, "", 1, 4, None), (2, None, None, 1, 1, 1, None, None, None, None)]
    got = {r["host"]: r for r in tree.host_totals(spark.createDataFrame(rows, schema)).collect()}
    assert (got["a.b"]["pages"], got["a.b"]["errors"], got["a.b"]["batches"], got["a.b"]["first_seen"]) == (5, 1, 2, 1)
    assert got[""]["pages"] == 1
    empty = spark.createDataFrame([], schema)
    assert tree.host_totals(empty).count() == 0 and tree.hot_hosts(empty).count() == 0
    assert {r["host"] for r in tree.hot_hosts(spark.createDataFrame(rows, schema)).collect()} == {"a.b", ""}


def test_outcome(spark):
    df = spark.createDataFrame([(0, False), (429, True), (503, True), (404, True), (403, True), (500, True), (200, False), (200, True)], "s int, b boolean")
    o = outcome.outcome(F.col("s"), F.col("b"), F.lit(True), F.lit(False))
    got = [(r["o"]["state"], r["o"]["ok"], r["o"]["label"]) for r in df.select(o.alias("o")).collect()]
    assert got == [("dead", False, "no response"), ("pending", False, "client error"), ("pending", False, "server error"), ("done", False, "not found"), ("done", False, "client error"), ("done", False, "server error"), ("done", False, ""), ("done", True, "")]
    no_index = outcome.outcome(F.lit(200), F.lit(True), F.lit(True), F.lit(True))
    assert spark.range(1).select(no_index.alias("o")).first()["o"]["store"] is False
    kinds = spark.createDataFrame([("Text/HTML; charset=x",), ("image/png",), (None,)], "t string").select(outcome.is_html(F.col("t")).alias("x"))
    assert [r["x"] for r in kinds.collect()] == [True, False, True]
    assert spark.range(1).select(outcome.short_error(F.lit("a: b: timeout")).alias("x")).first()["x"] == "timeout"


def test_frontier(spark):
    cand = spark.createDataFrame([("http://a.example/1", 0), ("http://a.example/1", 4), ("http://b.example/2", 300), ("", 0), (None, 1), ("http://c.example/3", 2)], "url string, depth long")
    seen = spark.createDataFrame([("http://c.example/3", 2, 0)], "url string, state int, done_at long")
    new = frontier.enqueue(cand, seen)
    assert {(r["url"], r["host"], r["depth"]) for r in new.collect()} == {("http://a.example/1", "a.example", 0), ("http://b.example/2", "b.example", 300)}
    assert [r["pri"] for r in frontier.with_order(new).orderBy("pri").collect()] == [0, 255]
    assert [r["lease"] for r in frontier.lease(new, 2).collect()] == [1, 2]
    state = spark.createDataFrame([("a", 1, 10), ("b", 1, 20), ("c", 1, 30), ("d", 0, 5), ("e", 1, None)], "url string, state int, done_at long")
    assert [r["url"] for r in frontier.recrawl_due(state, 30, 9).collect()] == ["a", "b"]
    assert frontier.recrawl_policy(300_000, 336, 0) is None and frontier.recrawl_policy(100, 336, 7200) == (3600, 20_000)
    assert frontier.refill_target(16, 0) == 4000 and frontier.refill_target(1000, 10) == 59_990


def test_fail_streaks_brute_force(spark):
    random.seed(3)
    rows = [dict(seq=i * 700, host=random.choice(["a", "b"]), status=random.choice([200, 500, 0, 503])) for i in range(400)]
    want, run = {}, {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        bad = r["status"] == 0 or r["status"] >= 500
        run[r["host"]] = run.get(r["host"], 0) + 1 if bad else 0
        want[r["seq"]] = run[r["host"]]
    got = {r["seq"]: r["streak"] for r in frontier.fail_streaks(log(spark, rows)).collect()}
    assert got == want


def test_near_pairs_brute_force(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(12)]
    fps = list(base)
    for b in base:
        for flips in (1, 4, 7, 8, 9):
            x = b
            for bit in random.sample(range(64), flips):
                x ^= 1 << bit
            fps.append(x)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps] + [0, 0]
    band = lambda a, b: any((a >> 8 * i) & 255 == (b >> 8 * i) & 255 for i in range(8))
    want = {(a, b) for a in set(signed) for b in set(signed) if a < b and a and b and bin((a ^ b) & (2**64 - 1)).count("1") <= 8 and band(a, b)}
    df = spark.createDataFrame(list(enumerate(signed)), "seq long, fp long")
    assert {(r["a"], r["b"]) for r in dedup.near_pairs(df).collect()} == want


def test_suppress(spark):
    schema = "seq long, url string, title string, description string, body string"
    text = "the ferry council met on monday to discuss the new timetable for the island and its many small harbours " * 3
    docs = spark.createDataFrame([(1, "u1", "t", None, text), (2, "u2", "t", "", "quite another text about bread and butter"), (3, "u3", None, None, None)], schema)
    fp = fingerprint_text("t\n\n" + text)
    old = spark.createDataFrame([("u0", fp), ("u3", 0)], "url string, fp long")
    assert {r["seq"] for r in dedup.suppress(docs, old).collect()} == {2, 3}
    flags = {r["seq"]: r["is_copy"] for r in dedup.near_dup_flags(dedup.fingerprints(docs.unionByName(docs.withColumn("seq", F.col("seq") + 10)))).collect()}
    assert flags[1] is False and flags[11] is True and flags[3] is False


def test_query_parser():
    lits = search.parse_query('harbour "new council" title:ferry -bread NOT butter a OR b')
    assert [(x.terms, x.field, x.negated) for x in lits] == [
        (("harbour",), None, False), (("new", "council"), None, False), (("ferry",), "title", False), (("bread",), None, True), (("butter",), None, True), (("a",), None, False), (("b",), None, False)
    ]
    assert [x.must for x in lits[-2:]] == [False, False]


def test_search(spark):
    schema = "seq long, url string, host string, title string, description string, body string, category string, lang string, depth int, fetched_at long"
    rows = [(1, "http://a.example/", "a.example", "Harbour council", "", "council council", "news", "en", 0, 5), (2, "http://b.example/x?y=1", "b.example", None, None, "the council met", "news", "en", 3, 9), (3, "http://c.example/", "c.example", "x", "y", "council harbour", "blog", "en", 0, 7)]
    docs = spark.createDataFrame(rows, schema)
    strict = search.search(docs, search.SearchParams("harbour council"))
    assert strict.total == 2 and not strict.relaxed and [r["seq"] for r in strict.hits.collect()] == [1, 3]
    loose = search.search(docs, search.SearchParams("council zzz"))
    assert loose.relaxed and loose.total == 3
    phrase = search.match(docs, search.parse_query('"harbour council"'))
    assert [r["seq"] for r in phrase.collect()] == [1]
    recent = search.search(docs, search.SearchParams("council", recent=True, category=" news "))
    assert [r["seq"] for r in recent.hits.collect()] == [2, 1]
    assert [r["seq"] for r in search.search(docs, search.SearchParams("a.example")).hits.collect()] == [1]
    one = docs.where("seq = 1").select(search.quality(F.lit(0), F.lit("https://example.com/"), F.lit("t"), F.lit("d")).alias("q")).first()["q"]
    assert round(one, 3) == 1.239


def test_alerts(spark):
    args = lambda *v: [F.lit(x) for x in v]
    kind = lambda *v: spark.range(1).select(alerts.condition(*args(*v), 20480).alias("k")).first()["k"]
    assert kind(0, 9999, 10, 0.5, 0.25, 0) == "errors" and kind(0, 9999, 10, 0.5, 0.0, 0) is None
    assert kind(0, 0, 0, 0.0, 0.0, 20481) == "disk" and kind(601, 601, 0, 0.0, 0.0, 99999) == "stall"
    sent = alerts.cooled(spark.createDataFrame([(0, "disk"), (1800, "disk"), (3600, "disk"), (60, "stall")], "ts long, kind string"))
    assert {(r["kind"], r["ts"]) for r in sent.collect()} == {("disk", 0), ("disk", 3600), ("stall", 60)}


def test_geo(spark):
    blocks = spark.createDataFrame([("1.0.0.0/8", "US"), ("1.2.0.0/16", "DE")], "c string, country string")
    low, high = geo.cidr_range(F.col("c"))
    blocks = blocks.select(low.alias("lo"), high.alias("hi"), "country")
    ips = spark.createDataFrame([("1.2.3.4", "h", 1), ("1.9.9.9", "h", 0), ("8.8.8.8", "g", 2), ("bad", "f", 3)], "ip string, host string, seq long")
    got = {r["ip"]: r["country"] for r in geo.locate(ips, blocks).collect()}
    assert got == {"1.2.3.4": "DE", "1.9.9.9": "US", "8.8.8.8": None, "bad": None}
    assert geo.host_location(geo.locate(ips, blocks)).where("host = 'h'").first()["country"] == "US"


def test_sources(spark):
    lines = spark.createDataFrame([("# c", 0), (" a.example ", 1), ("", 2), ("http://b.example", 3), ("a.example", 4)], "value string, pos int")
    assert {(r["url"], r["pos"]) for r in readers.seed_lines(lines).collect()} == {("https://a.example", 1), ("http://b.example", 3)}
    top = spark.createDataFrame([(x,) for x in ("1,a.com", "2,B.com", "", "bad", "3,localhost", "4,c.com")], "value string")
    assert [r["domain"] for r in readers.top_domains(top, 1, 2).collect()] == ["b.com", "c.com"]
    hits = spark.createDataFrame([('{"hits": [{"url": "http://x.example/"}, {"url": ""}, {"url": null}, {"url": "http://x.example/"}]}',)], "value string")
    assert [r["url"] for r in readers.json_hits(hits, 5).collect()] == ["http://x.example/"]
    assert readers.feed_links("see https://e.com/a, and (https://e.com/b).") == ["https://e.com/a", "https://e.com/b"]
    assert readers.feed_links("<opml><body><outline><outline xmlUrl='http://f.example/x'/></outline></body></opml>") == ["http://f.example/x"]
    assert readers.feed_links("<rss><channel><item><link>http://i.example/1</link></item></channel></rss>") == ["http://i.example/1"]
    assert readers.unzip_first(b"plain") == b"plain"
    fetched = spark.createDataFrame([("h", 200, "b", 5), ("i", 500, "", 5), ("j", 404, "x", 5)], "host string, status int, body string, fetched_at long")
    table = readers.robots_table(fetched)
    assert {r["host"]: r["body"] for r in table.collect()} == {"h": "b", "i": "User-agent: *\nDisallow: /", "j": ""}
    assert {r["host"]: r["body"] for r in readers.fresh_robots(fetched.select("host"), table, 90_000).collect()} == {"h": None, "i": None, "j": None}
