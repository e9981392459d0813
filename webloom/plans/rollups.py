"""Roll-up, series, outcome and alert queries over ``fetch_log`` and ``hosts``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import alerts, frontier, geo, outcome, rollup
from webloom.operators.tree import host_key, host_totals, hot_hosts
from webloom.plans.base import EV, HOST, LAST_CATEGORY, query
from webloom.session import table


def events(spark: SparkSession, d: str) -> DataFrame:
    return rollup.distinct_events(table(spark, d, "fetch_log"))


@query("p2_found", f"""WITH d AS (SELECT DISTINCT batch, {HOST} AS host FROM hosts), n AS (SELECT host, count(*) AS n FROM d GROUP BY 1), t AS (SELECT sum(n) AS total FROM n)
SELECT host FROM n, t WHERE n >= 0.02 * total""")  # fmt: skip
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_hosts(table(spark, d, "hosts")).select("host")


@query("p2_host_totals", f"""WITH d AS (SELECT batch, {HOST} AS host, max(pages) AS pages, max(errors) AS errors, max(bytes) AS bytes,
min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM hosts GROUP BY 1, 2)
SELECT host, count(*)::BIGINT AS batches, sum(pages)::BIGINT AS pages, sum(errors)::BIGINT AS errors, sum(bytes)::BIGINT AS bytes,
min(first_seen)::BIGINT AS first_seen, max(last_seen)::BIGINT AS last_seen FROM d GROUP BY 1""")  # fmt: skip
def p2_host_totals(spark: SparkSession, d: str) -> DataFrame:
    return host_totals(table(spark, d, "hosts"))


@query("top_hosts", f"WITH {EV} SELECT host, count(*)::BIGINT AS pages, sum(bytes)::BIGINT AS bytes FROM ev WHERE ok GROUP BY 1 ORDER BY pages DESC, host LIMIT 25")
def top_hosts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("ok").groupBy("host").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes")).orderBy(F.desc("pages"), "host").limit(25)


_ROLLUP = f"""SELECT host, sum(ok::INT)::BIGINT AS pages, sum((NOT ok)::INT)::BIGINT AS errors, sum(CASE WHEN ok THEN bytes ELSE 0 END)::BIGINT AS bytes,
{LAST_CATEGORY} AS category, min(sec) AS first_seen, max(sec) AS last_seen FROM ev GROUP BY 1"""


@query("host_rollup", f"WITH {EV} {_ROLLUP}")
def host_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.host_rollup(events(spark, d))


@query("host_rollup_merged", f"WITH {EV} {_ROLLUP}")
def host_rollup_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two halves rolled up apart and merged equal the whole."""
    ev = events(spark, d)
    cut = ev.approxQuantile("seq", [0.5], 0.05)[0]
    return rollup.merge_rollups(rollup.host_rollup(ev.where(F.col("seq") <= cut)), rollup.host_rollup(ev.where(F.col("seq") > cut)))


def _labels(name: str) -> str:
    return f"WITH {EV} SELECT {name} AS label, count(*)::BIGINT AS n FROM ev WHERE ok AND trim(coalesce({name},'')) <> '' GROUP BY 1"


@query("category_counts", _labels("category"))
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollup.label_counts(events(spark, d), "category")


@query("lang_counts", _labels("lang") + " ORDER BY n DESC, label LIMIT 12")
def lang_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollup.label_counts(events(spark, d), "lang").orderBy(F.desc("n"), "label").limit(12)


@query("country_counts", _labels("country") + " ORDER BY n DESC, label LIMIT 30")
def country_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollup.label_counts(events(spark, d), "country").orderBy(F.desc("n"), "label").limit(30)


@query("status_counts", f"WITH {EV} SELECT status::BIGINT AS status, count(*)::BIGINT AS n FROM ev WHERE status > 0 GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollup.status_counts(events(spark, d))


@query("status_buckets", f"""WITH {EV} SELECT CASE WHEN status BETWEEN 200 AND 299 THEN '2xx' WHEN status BETWEEN 300 AND 399 THEN '3xx' WHEN status BETWEEN 400 AND 499 THEN '4xx' ELSE '5xx' END AS bucket,
count(*)::BIGINT AS n FROM ev WHERE status > 0 GROUP BY 1""")  # fmt: skip
def status_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rollup.status_buckets(events(spark, d))


@query("totals", f"""WITH {EV}, t AS (SELECT coalesce(sum(ok::INT),0)::BIGINT AS pages, coalesce(sum(bytes) FILTER (WHERE ok),0)::BIGINT AS bytes, coalesce(sum((NOT ok)::INT),0)::BIGINT AS errors,
coalesce(sum(links) FILTER (WHERE ok),0)::BIGINT AS links, count(*)::BIGINT AS fetches FROM ev) UNPIVOT t ON pages, bytes, errors, links, fetches INTO NAME k VALUE v""")  # fmt: skip
def totals(spark: SparkSession, d: str) -> DataFrame:
    return rollup.totals(events(spark, d))


@query("host_count", f"WITH {EV} SELECT count(DISTINCT host)::BIGINT AS hosts FROM ev")
def host_count(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).agg(F.countDistinct("host").alias("hosts"))


@query("host_count_approx")
def host_count_approx(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_log").agg(F.approx_count_distinct(host_key(F.col("host"))).alias("hosts"))


_SERIES = "sum(ok::INT)::BIGINT AS pages, sum(CASE WHEN ok THEN bytes ELSE 0 END)::BIGINT AS bytes, sum((NOT ok)::INT)::BIGINT AS errors"


@query("minute_series", f"WITH {EV} SELECT sec - sec % 60 AS ts, {_SERIES} FROM ev GROUP BY 1")
def minute_series(spark: SparkSession, d: str) -> DataFrame:
    return rollup.series(events(spark, d), 60)


@query("second_slots", f"""WITH {EV} SELECT sec, sum(ok::INT)::BIGINT AS pages, sum((NOT ok)::INT)::BIGINT AS errors, sum(CASE WHEN ok THEN bytes ELSE 0 END)::BIGINT AS bytes,
coalesce(sum(latency) FILTER (WHERE ok AND latency IS NOT NULL), 0)::BIGINT AS latency, count(*) FILTER (WHERE ok AND latency IS NOT NULL)::BIGINT AS lat_n FROM ev GROUP BY 1""")  # fmt: skip
def second_slots(spark: SparkSession, d: str) -> DataFrame:
    return rollup.second_slots(events(spark, d))


@query("minute_series_gapfilled", f"""WITH {EV}, m AS (SELECT sec - sec % 60 AS ts, {_SERIES} FROM ev GROUP BY 1), b AS (SELECT max(ts) AS hi, max(ts) - 1439 * 60 AS lo FROM m),
g AS (SELECT unnest(range(lo, hi + 1, 60)) AS ts FROM b)
SELECT g.ts, coalesce(pages,0)::BIGINT AS pages, coalesce(bytes,0)::BIGINT AS bytes, coalesce(errors,0)::BIGINT AS errors FROM g LEFT JOIN m ON m.ts = g.ts""")  # fmt: skip
def minute_series_gapfilled(spark: SparkSession, d: str) -> DataFrame:
    """The last day by minutes, empty ones 0."""
    points = rollup.series(events(spark, d), 60)
    last = points.agg(F.max("ts")).first()[0] or 0
    return rollup.fill_grid(points, last - 1439 * 60, last, 60, ["pages", "bytes", "errors"])


@query("spark_series", f"""WITH {EV}, s AS (SELECT sec AS ts, sum(ok::INT)::BIGINT AS pages FROM ev GROUP BY 1), b AS (SELECT max(ts) AS hi FROM s)
SELECT g AS ts, coalesce(pages,0)::BIGINT AS pages FROM (SELECT unnest(range(hi - 59, hi + 1)) AS g FROM b) x LEFT JOIN s ON s.ts = g""")  # fmt: skip
def spark_series(spark: SparkSession, d: str) -> DataFrame:
    """Ok pages of the last sixty seconds, the current one included."""
    slots = rollup.second_slots(events(spark, d)).select(F.col("sec").alias("ts"), "pages")
    last = slots.agg(F.max("ts")).first()[0] or 0
    return rollup.fill_grid(slots.where(F.col("ts") >= last - 59), last - 59, last, 1, ["pages"])


@query("rolling_rates", f"""WITH {EV}, s AS (SELECT sec, sum(ok::INT) AS pages, sum((NOT ok)::INT) AS errors, sum(CASE WHEN ok THEN bytes ELSE 0 END) AS bytes,
coalesce(sum(latency) FILTER (WHERE ok AND latency IS NOT NULL),0) AS latency, count(*) FILTER (WHERE ok AND latency IS NOT NULL) AS lat_n FROM ev GROUP BY 1),
w AS (SELECT sec, coalesce(sum(pages) OVER q,0) AS qp, coalesce(sum(errors) OVER q,0) AS qe, coalesce(sum(bytes) OVER q,0) AS qb, coalesce(sum(pages) OVER m,0) AS mp,
coalesce(sum(errors) OVER m,0) AS me, coalesce(sum(latency) OVER m,0) AS ml, coalesce(sum(lat_n) OVER m,0) AS mn FROM s
WINDOW q AS (ORDER BY sec RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), m AS (ORDER BY sec RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT sec, round(qp / 10.0, 4)::DOUBLE AS pages_per_sec, round(qe / 10.0, 4)::DOUBLE AS errors_per_sec, round(qb / 10.0, 4)::DOUBLE AS bytes_per_sec, mp::BIGINT AS pages_per_min,
round(coalesce(ml / nullif(mn,0)::DOUBLE, 0), 4)::DOUBLE AS avg_latency_ms, round(coalesce(mp / nullif(mp + me,0)::DOUBLE, 0), 4)::DOUBLE AS success_rate FROM w""")  # fmt: skip
def rolling_rates(spark: SparkSession, d: str) -> DataFrame:
    rates = rollup.rolling_rates(rollup.second_slots(events(spark, d)))
    rounded = [F.round(c, 4).alias(c) for c in ("pages_per_sec", "errors_per_sec", "bytes_per_sec", "avg_latency_ms", "success_rate")]
    return rates.select("sec", "pages_per_min", *rounded)


@query("recent_events", f"WITH {EV} SELECT seq, url, host, status::BIGINT AS status, ok FROM ev ORDER BY seq DESC LIMIT 60")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return rollup.recent(events(spark, d)).select("seq", "url", "host", F.col("status").cast("long").alias("status"), "ok")


@query("share_of_peak", f"""WITH {EV}, c AS (SELECT category AS label, count(*)::BIGINT AS n FROM ev WHERE ok AND trim(coalesce(category,'')) <> '' GROUP BY 1)
SELECT label, n, round(n / (SELECT max(n) FROM c)::DOUBLE, 6) AS share FROM c""")  # fmt: skip
def share_of_peak(spark: SparkSession, d: str) -> DataFrame:
    shares = rollup.share_of_peak(rollup.label_counts(events(spark, d), "category"))
    return shares.select("label", "n", F.round("share", 6).alias("share"))


@query("prune_metrics", f"WITH {EV}, m AS (SELECT sec - sec % 60 AS ts, {_SERIES} FROM ev GROUP BY 1) SELECT * FROM m WHERE ts >= (SELECT max(sec) FROM ev) - 30 * 86400")
def prune_metrics(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d)
    return rollup.prune(rollup.series(ev, 60), ev.agg(F.max("sec")).first()[0] or 0, 30)


_STATUS_TEXT = "CASE WHEN status = 0 THEN 'no response' WHEN status >= 500 THEN 'server error' WHEN status = 404 THEN 'not found' WHEN status >= 400 THEN 'client error' WHEN status >= 300 THEN 'redirect' ELSE '' END"


@query("status_text", f"WITH {EV} SELECT seq, {_STATUS_TEXT} AS text, left(string_split(err, ': ')[-1], 120) AS short_err FROM ev")
def status_text(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("seq", outcome.status_text(F.col("status")).alias("text"), outcome.short_error(F.col("err")).alias("short_err"))


@query("outcome_classify", f"""WITH {EV} SELECT seq, CASE WHEN status = 0 THEN 'dead' WHEN status IN (429,503) THEN 'pending' ELSE 'done' END AS state,
status BETWEEN 200 AND 299 AND bytes > 0 AS ok, status IN (429,503) AS retry, {_STATUS_TEXT} AS label FROM ev""")  # fmt: skip
def outcome_classify(spark: SparkSession, d: str) -> DataFrame:
    o = outcome.outcome(F.col("status"), F.coalesce("bytes", F.lit(0)) > 0, F.lit(True), F.lit(False))
    return events(spark, d).select("seq", o.alias("o")).select("seq", "o.state", "o.ok", "o.retry", "o.label")


@query("feed_rows", f"""WITH {EV} SELECT seq, CASE WHEN NOT ok THEN 'bad' WHEN status >= 400 THEN 'warn' ELSE 'ok' END AS kind, CASE WHEN status = 0 THEN 'ERR' ELSE status::VARCHAR END AS shown,
CASE WHEN p = '/' THEN '' ELSE p END AS path FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM ev)""")  # fmt: skip
def feed_rows(spark: SparkSession, d: str) -> DataFrame:
    return outcome.feed_rows(events(spark, d))


@query("fetch_gate", f"""WITH {EV} SELECT DISTINCT host, CASE WHEN host = '' THEN 'unparseable url' WHEN host LIKE 'm.%' THEN 'blocked by robots.txt' END AS reason FROM ev""")
def fetch_gate(spark: SparkSession, d: str) -> DataFrame:
    """Hosts whose name begins with 'm.' stand for those whose robots.txt forbids the page."""
    reason = outcome.fetch_gate(F.col("host"), True, ~F.col("host").startswith("m."))
    return events(spark, d).select("host", reason.alias("reason")).distinct()


_ALERTS = f"""m AS (SELECT sec - sec % 60 AS ts, {_SERIES} FROM ev GROUP BY 1), r AS (SELECT ts, pages, errors, max(CASE WHEN pages > 0 THEN ts END) OVER o AS last_page, min(ts) OVER o AS t0, sum(bytes) OVER o / 1048576.0 AS disk
FROM m WINDOW o AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)), a AS (SELECT ts, CASE WHEN ts - t0 > 600 AND ts - coalesce(last_page, t0) > 600 THEN 'stall'
WHEN pages + errors >= 5 AND pages > 0 AND pages / (pages + errors)::DOUBLE < 0.5 THEN 'errors' WHEN disk > 64 THEN 'disk' END AS kind FROM r)"""


@query("alert_conditions", f"WITH {EV}, {_ALERTS} SELECT ts, kind FROM a WHERE kind IS NOT NULL")
def alert_conditions(spark: SparkSession, d: str) -> DataFrame:
    return alerts.minute_alerts(rollup.series(events(spark, d), 60), 64)


@query("alert_cooldown")
def alert_cooldown(spark: SparkSession, d: str) -> DataFrame:
    return alerts.cooled(alert_conditions(spark, d))


@query("host_fail_streak", f"""WITH {EV}, b AS (SELECT seq, host, (status = 0 OR status >= 500) AS bad, sum((NOT (status = 0 OR status >= 500))::INT) OVER (PARTITION BY host ORDER BY seq) AS g FROM ev)
SELECT seq, host, CASE WHEN bad THEN sum(bad::INT) OVER (PARTITION BY host, g ORDER BY seq) ELSE 0 END::BIGINT AS streak FROM b""")  # fmt: skip
def host_fail_streak(spark: SparkSession, d: str) -> DataFrame:
    return frontier.fail_streaks(events(spark, d))


@query("host_daily_cap", f"WITH {EV} SELECT host, sec // 86400 AS day, count(*)::BIGINT AS n, count(*)::BIGINT - 20 AS over FROM ev GROUP BY 1, 2 HAVING count(*) > 20")
def host_daily_cap(spark: SparkSession, d: str) -> DataFrame:
    return frontier.daily_cap(events(spark, d), 20)


_CENTROIDS = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in geo.CENTROIDS.items())


@query("country_centroid", f"""WITH {EV}, c(country, lat, lon) AS (VALUES {_CENTROIDS}) SELECT e.country, lat::DOUBLE AS lat, lon::DOUBLE AS lon, n FROM
(SELECT upper(country) AS country, count(*)::BIGINT AS n FROM ev WHERE trim(coalesce(country,'')) <> '' GROUP BY 1) e LEFT JOIN c ON c.country = e.country""")  # fmt: skip
def country_centroid(spark: SparkSession, d: str) -> DataFrame:
    counted = events(spark, d).where("trim(coalesce(country, '')) <> ''").groupBy(F.upper("country").alias("country")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(geo.centroids(spark)), "country", "left").select("country", "lat", "lon", "n")
