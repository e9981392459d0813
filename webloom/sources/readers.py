"""Sources: seed lists, JSON and CSV link lists, feeds, archives, robots tables and spools."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.url import normalize_text, resolve_text

MAX_UNZIPPED = 64 << 20
MAX_HTML_LINKS = 1500
ROBOTS_TTL_S = 86_400
#: MMDB/CSV file names of a location database, best first (fixed values).
GEO_FILES = ("city.csv", "geo-city.csv", "country.csv", "geo-country.csv", "geo.csv")


def with_scheme(url):
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))


def seed_lines(lines: DataFrame) -> DataFrame:
    """(url, pos) of a seed list (value, pos): trimmed, no blanks or comments, first position of repeated urls."""
    line = F.trim("value")
    kept = lines.select(line.alias("url"), "pos").where((F.col("url") != "") & ~F.col("url").startswith("#"))
    return kept.select(with_scheme(F.col("url")).alias("url"), "pos").groupBy("url").agg(F.min("pos").alias("pos"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed list file; positions follow the file."""
    text = spark.read.text(path, wholetext=True)
    return seed_lines(text.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value")))


def json_hits(raw: DataFrame, limit: int) -> DataFrame:
    """(url, pos) of ``{"hits": [{"url": ...}]}`` documents (value): blank urls dropped, first of repeated ones, normalised."""
    hits = F.from_json("value", "hits array<struct<url:string>>")["hits"]["url"]
    found = raw.select(F.posexplode(hits).alias("pos", "url")).where("url is not null and trim(url) <> ''")
    return found.groupBy("url").agg(F.min("pos").alias("pos")).orderBy("pos", "url").limit(limit)


def top_domains(rows: DataFrame, after: int, want: int) -> DataFrame:
    """(rank, domain) of the ``want`` best ranks beyond ``after``; names need a dot. Input (value): 'rank,domain' lines."""
    parts = F.split("value", ",")
    parsed = rows.select(F.get(parts, F.lit(0)).try_cast("long").alias("rank"), F.lower(F.trim(F.get(parts, F.lit(1)))).alias("domain"))
    return parsed.where((F.col("rank") > after) & F.col("domain").contains(".")).orderBy("rank", "domain").limit(want)


def read_top_domains(spark: SparkSession, path: str, after: int, want: int) -> DataFrame:
    return top_domains(spark.read.text(path), after, want)


_PLAIN_URL = re.compile(r"https?://[^\s\"<>`]+")


def _xml_links(body: str) -> list[str]:
    try:
        root = ET.fromstring(body.strip())
    except ET.ParseError:
        return []
    out: list[str] = []
    local = lambda e: e.tag.rsplit("}", 1)[-1].lower()

    def link_of(e: ET.Element) -> None:
        for child in e:
            if local(child) == "link":
                out.append(child.get("href") or (child.text or "").strip())

    nodes = list(root.iter())
    for e in nodes:
        if local(e) == "item":
            link_of(e)
    for e in nodes:
        if local(e) == "entry":
            link_of(e)
    link_of(root)
    for e in nodes:
        if local(e) == "outline":
            out.extend(e.get(k) or "" for k in ("url", "xmlUrl", "htmlUrl"))
    return [u for u in out if u]


def feed_links(body: str | None, base: str = "", limit: int = 10_000) -> list[str]:
    """Links of a feed: XML (RSS, Atom, outlines at any depth), HTML, or plain text, told apart by its opening."""
    text = (body or "").lstrip("﻿ \t\r\n")
    head = text[:512].lower()
    if text.startswith("<") and not re.search(r"<!doctype html|<html", head):
        found = _xml_links(text)
    elif "<a " in head or "<html" in head or "<!doctype" in head:
        found = re.findall(r"<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)", text, re.I)[:MAX_HTML_LINKS]
        found = [resolve_text(base, u) or "" for u in found]
    else:
        found = [u.rstrip(".,;:!?)]}>'\"") for u in _PLAIN_URL.findall(text)]
    return list(dict.fromkeys(u for u in map(normalize_text, found) if u))[:limit]


@F.pandas_udf(T.ArrayType(T.StringType()))
def feed_urls(body: pd.Series) -> pd.Series:
    return pd.Series([feed_links(b) for b in body], dtype="object")


def unzip_first(data: bytes) -> bytes:
    """First file of a ZIP archive (at most 64 MiB), other data unchanged."""
    if not data.startswith(b"PK\x03\x04"):
        return data
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if not info.is_dir():
                with z.open(info) as f:
                    return f.read(MAX_UNZIPPED)
    return b""


@F.pandas_udf(T.BinaryType())
def unzipped(data: pd.Series) -> pd.Series:
    return pd.Series([unzip_first(bytes(d)) for d in data], dtype="object")


def robots_table(fetches: DataFrame) -> DataFrame:
    """(host, body, fetched_at, ok) from robots fetches (host, status, body, fetched_at): 200 keeps the body, 5xx denies all, other allows all."""
    body = F.when(F.col("status") == 200, F.left("body", F.lit(524_288))).when(F.col("status") >= 500, "User-agent: *\nDisallow: /").otherwise("")
    return fetches.select("host", body.alias("body"), "fetched_at", (F.col("status") < 500).alias("ok"))


def fresh_robots(hosts: DataFrame, robots: DataFrame, now: int) -> DataFrame:
    """Hosts with their cached robots body, null if it is missing or a day old."""
    valid = robots.where(F.col("fetched_at") > now - ROBOTS_TTL_S).select("host", "body")
    return hosts.join(valid, "host", "left")


def geo_blocks(spark: SparkSession, folder: str) -> DataFrame | None:
    """(lo, hi, country) of the best location file in the folder (CSV cidr,country); None if there is none."""
    from webloom.operators.geo import cidr_range

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in GEO_FILES:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")):
            rows = spark.read.option("header", True).csv(f"{folder}/{name}")
            low, high = cidr_range(F.col("cidr"))
            return rows.select(low.alias("lo"), high.alias("hi"), "country")
    return None


def folder_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """(store, bytes): size of each subfolder of a data folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    store = F.regexp_extract("path", re.escape(folder.replace("file:", "").rstrip("/")) + r"/([^/]+)", 1)
    return files.groupBy(store.alias("store")).agg(F.sum("length").alias("bytes"))


def log_tail(lines: DataFrame, n: int = 500) -> DataFrame:
    """The last ``n`` (at most 500) lines of a log (value, pos)."""
    return lines.orderBy(F.desc("pos")).limit(min(n, 500)).orderBy("pos")
