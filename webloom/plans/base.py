"""Registration of queries with their equivalent SQL, and SQL parts they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


HOST = "rtrim(lower(trim(coalesce(host,''))), '.')"
#: Events without replays, hosts in one spelling.
EV = f"""ev AS (SELECT seq, min(sec) AS sec, min(url) AS url, min({HOST}) AS host, min(status) AS status, bool_or(ok) AS ok, min(bytes) AS bytes,
min(latency) AS latency, min(depth) AS depth, min(links) AS links, min(category) AS category, min(lang) AS lang, min(country) AS country, min(err) AS err
FROM fetch_log GROUP BY seq)"""
#: URL parts of docs.
URL = """u AS (SELECT seq, url, trim(url) AS t,
lower(regexp_extract(trim(url), '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(trim(url), '^[a-zA-Z]+://([^/?#:@]+)', 1)) AS h,
regexp_extract(trim(url), '^[a-zA-Z]+://[^/?#]*(/[^?#]*)', 1) AS p, regexp_extract(trim(url), '(\\?[^#]*)', 1) AS q FROM docs)"""
SITE = """CASE WHEN len(string_split(h,'.')) <= 2 THEN h
WHEN array_to_string(string_split(h,'.')[-2:],'.') IN ('co.uk','org.uk','ac.uk','gov.uk','com.au','net.au','org.au','co.jp','co.nz','co.in','co.za','com.br','com.cn','com.mx','com.tr','com.sg')
THEN array_to_string(string_split(h,'.')[-3:],'.') ELSE array_to_string(string_split(h,'.')[-2:],'.') END"""
LAST_CATEGORY = "coalesce(max_by(category, seq) FILTER (WHERE trim(coalesce(category,'')) <> ''), '')"
