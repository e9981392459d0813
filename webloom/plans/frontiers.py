"""Frontier, source and near-duplicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import hashing, html, robots
from webloom.operators import dedup, frontier, geo, outcome, search
from webloom.plans.base import EV, query
from webloom.plans.rollups import events
from webloom.session import materialize, table
from webloom.sources import readers

#: Candidates: urls of the fetch log as links one deeper than their page.
_CAND = "cand AS (SELECT url, min(depth) + 1 AS depth FROM fetch_log WHERE coalesce(url,'') <> '' GROUP BY 1)"
_SEEN = "st AS (SELECT * FROM url_state)"
_ORD = "CASE WHEN depth < 0 OR depth >= 255 THEN 255 ELSE depth END AS pri, ('0x' || substr(md5(url),1,4))::INT AS rnd"
_KEY_HOST = "regexp_extract(url, '://([^/?#:]*)', 1)"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_log").select("url", (F.col("depth") + 1).alias("depth"))


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "url_state")


def _new(spark: SparkSession, d: str) -> DataFrame:
    return frontier.enqueue(_candidates(spark, d), _seen(spark, d))


_NEW = f"{_CAND}, {_SEEN}, new AS (SELECT url, {_KEY_HOST} AS host, depth FROM cand WHERE url NOT IN (SELECT url FROM st))"


@query("enqueue_new", f"WITH {_NEW} SELECT url, host, depth::BIGINT AS depth FROM new")
def enqueue_new(spark: SparkSession, d: str) -> DataFrame:
    return _new(spark, d).select("url", "host", F.col("depth").cast("long").alias("depth"))


@query("enqueue_added_count", f"WITH {_NEW} SELECT count(*)::BIGINT AS added FROM new")
def enqueue_added_count(spark: SparkSession, d: str) -> DataFrame:
    return _new(spark, d).agg(F.count("*").alias("added"))


@query("frontier_order", f"WITH {_NEW} SELECT url, {_ORD} FROM new ORDER BY pri, rnd, url LIMIT 4000")
def frontier_order(spark: SparkSession, d: str) -> DataFrame:
    return frontier.with_order(_new(spark, d)).orderBy("pri", "rnd", "url").limit(4000).select("url", "pri", "rnd")


@query("lease_batch", f"WITH {_NEW}, o AS (SELECT url, host, {_ORD} FROM new) SELECT url, host, row_number() OVER (ORDER BY pri, rnd, url) AS lease FROM o ORDER BY pri, rnd, url LIMIT 500")
def lease_batch(spark: SparkSession, d: str) -> DataFrame:
    return frontier.lease(_new(spark, d), 500).select("url", "host", "lease")


@query("round_robin_hosts", f"WITH {_NEW}, o AS (SELECT url, host, {_ORD} FROM new) SELECT url, host, row_number() OVER (PARTITION BY host ORDER BY pri, rnd, url)::INT AS turn FROM o QUALIFY turn <= 8")
def round_robin_hosts(spark: SparkSession, d: str) -> DataFrame:
    return frontier.round_robin(_new(spark, d), 8).select("url", "host", "turn")


@query("politeness_schedule", f"""WITH {_NEW}, o AS (SELECT url, host, {_ORD} FROM new), t AS (SELECT url, host, row_number() OVER (PARTITION BY host ORDER BY pri, rnd, url)::INT AS turn FROM o QUALIFY turn <= 64)
SELECT url, host, turn, ((turn - 1) * 1200)::BIGINT AS start_ms FROM t""")  # fmt: skip
def politeness_schedule(spark: SparkSession, d: str) -> DataFrame:
    return frontier.politeness(_new(spark, d), 1200, 64)


@query("recrawl_due", f"""WITH c AS (SELECT max(done_at) - 86400 AS cutoff FROM url_state) SELECT url, {_KEY_HOST} AS host, 0::INT AS depth, done_at FROM url_state, c
WHERE state = 1 AND done_at < cutoff ORDER BY done_at, url LIMIT 5000""")  # fmt: skip
def recrawl_due(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "url_state")
    newest = state.agg(F.max("done_at")).first()[0] or 0
    return frontier.recrawl_due(state, newest - 86_400, 5000)


@query("requeue_union", f"WITH {_NEW}, back AS (SELECT url, {_KEY_HOST} AS host, 0 AS depth FROM url_state WHERE state = 2) SELECT url, host, {_ORD} FROM new UNION ALL SELECT url, host, 255, ('0x' || substr(md5(url),1,4))::INT FROM back")
def requeue_union(spark: SparkSession, d: str) -> DataFrame:
    dead = table(spark, d, "url_state").where("state = 2").select("url", frontier.key_host(F.col("url")).alias("host"), F.lit(0).cast("long").alias("depth"))
    return frontier.requeue(_new(spark, d).withColumn("depth", F.col("depth").cast("long")), dead).select("url", "host", "pri", "rnd")


@query("seed_union", """WITH a AS (SELECT url, min(seq) AS pos FROM docs GROUP BY 1), b AS (SELECT url, min(seq) AS pos FROM fetch_log GROUP BY 1)
SELECT url, 0 AS src, pos FROM a UNION ALL SELECT url, 1, pos FROM b WHERE url NOT IN (SELECT url FROM a)""")  # fmt: skip
def seed_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select("url", F.col("seq").alias("pos")) for t in ("docs", "fetch_log")]
    return frontier.ordered_union(parts)


@query("discovery_budget", """WITH a AS (SELECT url, min(seq) AS pos FROM docs GROUP BY 1), b AS (SELECT url, min(seq) AS pos FROM fetch_log GROUP BY 1)
SELECT url, 0 AS src, pos FROM a UNION ALL SELECT url, 1, pos FROM b WHERE url NOT IN (SELECT url FROM a) ORDER BY src, pos, url LIMIT 500""")  # fmt: skip
def discovery_budget(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select("url", F.col("seq").alias("pos")) for t in ("docs", "fetch_log")]
    return frontier.ordered_union(parts, 500)


@query("complete_batch", f"""WITH {EV}, r AS (SELECT url, CASE WHEN status = 0 THEN 2 WHEN status IN (429,503) THEN 0 ELSE 1 END AS state, sec + seq % 7 * 0 AS done_at, seq FROM ev),
l AS (SELECT url, arg_max(state, (done_at, seq))::BIGINT AS state, max(done_at) AS done_at FROM r GROUP BY 1)
SELECT url, state::BIGINT AS state, done_at FROM url_state WHERE url NOT IN (SELECT url FROM l) UNION ALL SELECT url, state, done_at FROM l""")  # fmt: skip
def complete_batch(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d)
    state = F.when(F.col("status") == 0, 2).when(F.col("status").isin(429, 503), 0).otherwise(1)
    last = ev.select("url", "seq", "sec", state.cast("long").alias("state")).groupBy("url").agg(F.max_by("state", F.struct("sec", "seq")).alias("state"), F.max("sec").alias("done_at"))
    seen = table(spark, d, "url_state").select("url", F.col("state").cast("long").alias("state"), "done_at")
    return frontier.complete(last, seen)


@query("frontier_gauges", """SELECT count(*) FILTER (WHERE state = 0)::BIGINT AS pending, count(*) FILTER (WHERE state = 1)::BIGINT AS done, count(*) FILTER (WHERE state = 2)::BIGINT AS dead,
greatest(0, (SELECT max(seq) FROM docs) - 500)::BIGINT AS spool_depth FROM url_state""")  # fmt: skip
def frontier_gauges(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda s: F.sum((F.col("state") == s).cast("long"))
    tail = table(spark, d, "docs").agg(F.greatest(F.lit(0), F.max("seq") - 500).alias("spool_depth"))
    return table(spark, d, "url_state").agg(is_(0).alias("pending"), is_(1).alias("done"), is_(2).alias("dead")).join(F.broadcast(tail))


@query("spool_read", "SELECT seq, url FROM docs WHERE seq > 100 ORDER BY seq LIMIT 500")
def spool_read(spark: SparkSession, d: str) -> DataFrame:
    return search.spool(table(spark, d, "docs"), 100).select("seq", "url")


@query("upsert_latest_by_url", "SELECT seq, url, left(body, 1200) AS excerpt FROM docs QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1")
def upsert_latest_by_url(spark: SparkSession, d: str) -> DataFrame:
    return search.latest_by_url(table(spark, d, "docs")).select("seq", "url", F.left("body", F.lit(1200)).alias("excerpt"))


@query("simhash_docs")
def simhash_docs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.fingerprints(table(spark, d, "docs"))


@query("simhash_bands")
def simhash_bands(spark: SparkSession, d: str) -> DataFrame:
    return dedup.fingerprints(table(spark, d, "docs")).select("seq", hashing.bands(F.col("fp")).alias("bands"))


@query("near_dup_flag")
def near_dup_flag(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its class, its links to other texts, and whether an earlier neighbour exists."""
    return dedup.near_dup_flags(materialize(dedup.fingerprints(table(spark, d, "docs")), "fingerprints"))


@query("near_dup_pairs")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_pairs(materialize(dedup.fingerprints(table(spark, d, "docs")), "fingerprints"))


@query("dedup_suppressed")
def dedup_suppressed(spark: SparkSession, d: str) -> DataFrame:
    """Later half of the documents less those near one of the first half."""
    docs = table(spark, d, "docs")
    middle = docs.approxQuantile("seq", [0.5], 0.01)[0]
    old = dedup.fingerprints(docs.where(F.col("seq") <= middle)).select("url", "fp")
    return dedup.suppress(docs.where(F.col("seq") > middle), old).select("seq")


@query("fingerprint_count", "SELECT count(DISTINCT url)::BIGINT AS n FROM docs")
def fingerprint_count(spark: SparkSession, d: str) -> DataFrame:
    fps = dedup.fingerprints(table(spark, d, "docs")).select("url", "fp")
    half = fps.groupBy("url").agg(F.max("fp").alias("fp"))
    return dedup.upsert(half, half).agg(F.count("*").alias("n"))


@query("robots_allowed")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Paths of all pages against one robots file per kind of host."""
    body = F.when(F.col("host").startswith("m."), "User-agent: *\nDisallow: /").otherwise("User-agent: *\nDisallow: /*.html$\nAllow: /a")
    request = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1)
    return table(spark, d, "docs").select("seq", robots.gate("mozilla")(body, request).alias("allowed"))


@query("geo_lookup")
def geo_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A country per host by the narrowest block that holds an address made from the host's hash."""
    blocks = spark.createDataFrame([("10.0.0.0/8", "US"), ("10.64.0.0/10", "DE"), ("10.128.0.0/9", "FR"), ("10.200.0.0/16", "JP")], "cidr string, country string")
    low, high = geo.cidr_range(F.col("cidr"))
    h = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")
    ip = F.concat_ws(".", F.lit("10"), F.floor(h / 65536), F.floor(h / 256) % 256, h % 256)
    ips = table(spark, d, "docs").where("host is not null").select(ip.alias("ip"), "host", "seq")
    return geo.host_location(geo.locate(ips, blocks.select(low.alias("lo"), high.alias("hi"), "country")))


@query("top_csv_window")
def top_csv_window(spark: SparkSession, d: str) -> DataFrame:
    """Hosts ranked by fetches as 'rank,domain' lines; ten ranks beyond the fifth."""
    ranked = events(spark, d).groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(1000)
    lines = [f"{i},{r['host']}" for i, r in enumerate(ranked.toLocalIterator(), 1)]
    return readers.top_domains(spark.createDataFrame([(x,) for x in lines], "value string"), 5, 10)


@query("feed_urls")
def feed_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in the text of pages."""
    docs = table(spark, d, "docs").where(F.col("body").contains("http"))
    return docs.select("seq", F.explode(readers.feed_urls(F.col("body"))).alias("url"))


@query("extract_pages")
def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages set as HTML again (title, description, paragraphs, a link) and extracted."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(
        F.lit("<html lang='"), F.coalesce("lang", F.lit("")), F.lit("'><head><title>"), esc(F.col("title")), F.lit("</title><meta name=description content=\""),
        F.replace(esc(F.col("description")), F.lit('"'), F.lit("&quot;")), F.lit("\"><style>p{}</style></head><body><p>"),
        F.replace(esc(F.col("body")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p><a href='/next'>n</a><script>x</script></body></html>"),
    )
    out = html.extract_page(page, F.coalesce("url", F.lit("")))
    return table(spark, d, "docs").select("seq", out.alias("x")).select("seq", "x.title", "x.lang", "x.text", F.size("x.links").alias("n_links"))


@query("link_harvest")
def link_harvest(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in page texts as links below depth two."""
    docs = table(spark, d, "docs").where(F.col("body").contains("http"))
    return outcome.harvest(docs.select(readers.feed_urls(F.col("body")).alias("links"), "depth"), 2, crawl_adult=False)
