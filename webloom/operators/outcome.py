"""Fetch gate, outcome classification and event projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import is_adult_host

HTML_TYPES = ("text/html", "application/xhtml+xml", "application/xml", "text/xml", "")


def is_html(content_type: Column) -> Column:
    return F.trim(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1)).isin(*HTML_TYPES)


def status_text(status: Column) -> Column:
    return (
        F.when(status == 0, "no response").when(status >= 500, "server error").when(status == 404, "not found")
        .when(status >= 400, "client error").when(status >= 300, "redirect").otherwise("")
    )


def short_error(err: Column) -> Column:
    """Text after the last ': ', at most 120 bytes; a character cut in two becomes a replacement mark."""
    text = F.substring_index(err, ": ", -1)
    return F.when(F.octet_length(text) <= 120, text).otherwise(F.decode(F.substring(F.encode(text, "UTF-8"), 1, 120), "UTF-8"))


def outcome(status: Column, has_body: Column, html: Column, noindex: Column) -> Column:
    """Struct (state, ok, retry, store, label): what becomes of a fetched url."""
    failed, later = status == 0, status.isin(429, 503)
    good = status.between(200, 299) & has_body
    state = F.when(failed, "dead").when(later, "pending").otherwise("done")
    ok = ~failed & ~later & good & html
    label = F.when(failed | later | ~status.between(200, 299), status_text(status)).when(~has_body, "").when(~html, "non-html").otherwise("")
    return F.struct(state.alias("state"), ok.alias("ok"), later.alias("retry"), (ok & ~noindex).alias("store"), label.alias("label"))


def fetch_gate(host: Column, crawl_adult: bool, robots_allowed: Column) -> Column:
    """Reason to skip a url, null if it may be fetched."""
    adult = F.lit(False) if crawl_adult else is_adult_host(host)
    return F.when(adult, "adult content disabled").when(host == "", "unparseable url").when(~robots_allowed, "blocked by robots.txt")


def feed_rows(events: DataFrame) -> DataFrame:
    """Display rows: class, shown status and path."""
    kind = F.when(~F.col("ok"), "bad").when(F.col("status") >= 400, "warn").otherwise("ok")
    shown = F.when(F.col("status") == 0, "ERR").otherwise(F.col("status").cast("string"))
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return events.select("seq", kind.alias("kind"), shown.alias("shown"), F.when(path == "/", "").otherwise(path).alias("path"))


def harvest(pages: DataFrame, max_depth: int, crawl_adult: bool) -> DataFrame:
    """Links (url, host, depth + 1) of pages above the depth limit, hosts permitting."""
    from webloom.functions.url import key_host

    open_ = pages if max_depth < 0 else pages.where(F.col("depth") < max_depth)
    links = open_.select(F.explode("links").alias("url"), (F.col("depth") + 1).alias("depth")).withColumn("host", key_host(F.col("url")))
    kept = links.where("host <> ''")
    return kept if crawl_adult else kept.where(~is_adult_host(F.col("host")))
