"""URL and text queries over ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import hashing, text, url
from webloom.plans.base import SITE, URL, query
from webloom.session import table

_SKIP = ",".join(f"'{x}'" for x in url.SKIP_EXTENSIONS)
_TRACK = ",".join(f"'{x}'" for x in url.TRACKING_PARAMS)
_EXT = "CASE WHEN length(regexp_extract(p, '(\\.[^./]*)$', 1)) > 6 THEN '' ELSE lower(regexp_extract(p, '(\\.[^./]*)$', 1)) END"
_LOCAL = "(h IN ('localhost','127.0.0.1','0.0.0.0','::1') OR h LIKE '%.local' OR h LIKE '%.localhost' OR h LIKE '192.168.%' OR h LIKE '10.%' OR h LIKE '169.254.%')"
_ENC = "replace(url_encode({}), '%20', '+')"


@query(
    "url_normalize",
    f"""WITH {URL}, k AS (SELECT seq, list_sort([{{'k': url_decode(replace(split_part(x,'=',1),'+',' ')), 'i': i - 1,
'v': CASE WHEN contains(x,'=') THEN url_decode(replace(regexp_extract(x,'^[^=]*=(.*)$',1),'+',' ')) ELSE '' END}}
FOR x, i IN list_filter(string_split(substr(q,2),'&'), lambda y: y <> '') IF lower(url_decode(replace(split_part(x,'=',1),'+',' '))) NOT IN ({_TRACK})]) AS ps FROM u)
SELECT u.seq, CASE WHEN scheme IN ('http','https') AND contains(h,'.') AND NOT ends_with(h,'.') AND NOT {_LOCAL} AND {_EXT} NOT IN ({_SKIP}) AND strlen(t) <= 2000
THEN scheme || '://' || h || CASE WHEN p = '' THEN '/' ELSE regexp_replace(p,'/{{2,}}','/','g') END
|| CASE WHEN q = '' THEN '' WHEN q = '?' THEN '?' WHEN len(ps) = 0 THEN '' ELSE '?' || array_to_string(list_transform(ps, lambda s: {_ENC.format('s.k')} || '=' || {_ENC.format('s.v')}),'&') END
END AS normal FROM u JOIN k USING (seq)""",
)
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("seq", url.normalize(F.col("url")).alias("normal"))


@query("url_normalize_general")
def url_normalize_general(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("seq", url.normalize_any(F.col("url")).alias("normal"))


@query(
    "url_host_site_tld",
    f"""WITH {URL} SELECT seq, h AS url_host, {SITE} AS url_site, CASE WHEN contains(h,'.') THEN string_split(h,'.')[-1] ELSE '' END AS tld,
regexp_extract(url,'://([^/?#:]*)',1) AS key_host FROM u""",
)
def url_host_site_tld(spark: SparkSession, d: str) -> DataFrame:
    h = url.host(F.col("url"))
    return table(spark, d, "docs").select("seq", h.alias("url_host"), url.site(h).alias("url_site"), url.tld(h).alias("tld"), url.key_host(F.col("url")).alias("key_host"))


@query("url_extension_skip", f"WITH {URL}, e AS (SELECT seq, {_EXT} AS ext FROM u) SELECT seq, ext, ext IN ({_SKIP}) AS skipped FROM e")
def url_extension_skip(spark: SparkSession, d: str) -> DataFrame:
    ext = url.extension(url.path(F.col("url")))
    return table(spark, d, "docs").select("seq", ext.alias("ext"), ext.isin(url.SKIP_EXTENSIONS).alias("skipped"))


@query("url_local_filter", f"WITH {URL} SELECT seq, {_LOCAL} AS is_local FROM u")
def url_local_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("seq", url.is_local_host(url.host(F.col("url"))).alias("is_local"))


@query(
    "url_request_path",
    f"WITH {URL} SELECT seq, CASE WHEN p = '' THEN '/' ELSE p END || q AS request, regexp_replace(CASE WHEN p = '' THEN '/' ELSE p END, '/{{2,}}', '/', 'g') AS collapsed FROM u",
)
def url_request_path(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "docs").select("seq", url.request_path(u).alias("request"), url.collapse_slashes(url.path(u)).alias("collapsed"))


@query(
    "url_breadcrumb",
    f"""WITH {URL} SELECT seq, CASE WHEN h = '' THEN url ELSE array_to_string(list_concat([h], list_transform(list_filter(string_split(p,'/'), lambda s: s <> '')[:4],
lambda s: url_decode(s))), ' › ') END AS crumb FROM u""",
)
def url_breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("seq", url.breadcrumb(F.col("url")).alias("crumb"))


@query("url_resolve_links")
def url_resolve_links(spark: SparkSession, d: str) -> DataFrame:
    """Each page's path resolved against the page before it in its host, and a few link forms."""
    docs = table(spark, d, "docs")
    forms = F.array(F.lit("../up"), F.lit("/für"), F.lit("?page=3"), F.lit("#top"), F.lit("mailto:a@b.c"), F.col("url"))
    return docs.select("seq", "url", F.explode(forms).alias("href")).select("seq", "href", url.resolve(F.col("url"), F.col("href")).alias("target"))


@query("host_geo_hash")
def host_geo_hash(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = hashing.host_position(F.col("host"))
    return table(spark, d, "docs").where("host is not null").select("host").distinct().select("host", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(
    "lang_normalize",
    """SELECT seq, coalesce(CASE WHEN regexp_matches(l, '^[a-z]{2,3}$') THEN l END, '') AS code FROM
(SELECT seq, split_part(trim(split_part(split_part(lower(trim(lang)), ',', 1), ';', 1)), '-', 1) AS l FROM docs)""",
)
def lang_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("seq", text.normalize_lang(F.col("lang")).alias("code"))


def _script_sql() -> str:
    counts = ", ".join(f"length(regexp_replace(s, '[^{r}]', '', 'g')) AS {x}" for x, r in text.SCRIPTS)
    names = ", ".join(x for x, _ in text.SCRIPTS)
    cases = " ".join(f"WHEN {x} = top THEN '{x}'" for x, _ in text.SCRIPTS)
    head = "CASE WHEN strlen(body) <= 2001 THEN body ELSE left(body, len(list_filter(range(1, 2002), lambda k: strlen(left(body, k::INT - 1)) <= 2000))) END"
    return f"""WITH l AS (SELECT seq, regexp_replace(coalesce({head},''), '[\\s\\p{{P}}\\p{{Nd}}]', '', 'g') AS s FROM docs),
c AS (SELECT seq, length(s) AS n, {counts} FROM l), t AS (SELECT *, greatest({names}) AS top FROM c)
SELECT seq, CASE WHEN n < 20 THEN '' WHEN top * 4 <= n THEN 'en' {cases} ELSE '' END AS script FROM t"""


@query("lang_guess_script", _script_sql())
def lang_guess_script(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("seq", text.guess_script(F.coalesce("body", F.lit(""))).alias("script"))


@query(
    "page_language",
    _script_sql().replace("SELECT seq, CASE WHEN n < 20", "SELECT t.seq, coalesce(nullif(CASE WHEN regexp_matches(g, '^[a-z]{2,3}$') THEN g ELSE '' END, ''), CASE WHEN n < 20").replace(
        "END AS script FROM t", "END) AS lang FROM t JOIN (SELECT seq, split_part(trim(split_part(split_part(lower(trim(lang)), ',', 1), ';', 1)), '-', 1) AS g FROM docs) x USING (seq)"
    ),
)
def page_language(spark: SparkSession, d: str) -> DataFrame:
    tag = text.normalize_lang(F.col("lang"))
    guess = text.guess_script(F.coalesce("body", F.lit("")))
    return table(spark, d, "docs").select("seq", F.coalesce(F.when(tag != "", tag), guess).alias("lang"))


def _classify_sql() -> str:
    def any_of(column: str, parts: str) -> str:
        return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts.split("|")) + ")" if parts else "false"

    cases = " ".join(f"WHEN {any_of('h', a)} OR {any_of('p', b)} OR {any_of('t', c)} THEN '{x}'" for x, a, b, c in text.RULES)
    return f"""WITH s AS (SELECT seq, lower(coalesce(host,'')) AS h, lower(CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/[^?#]*)', 1) = '' THEN '/'
ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/[^?#]*)', 1) END) AS p, lower(coalesce(title,'') || ' ' || coalesce(description,'')) AS t FROM docs)
SELECT seq, CASE WHEN h = 'x.com' OR ends_with(h, '.x.com') THEN 'social' {cases} ELSE 'other' END AS category FROM s"""


@query("classify_pages", _classify_sql())
def classify_pages(spark: SparkSession, d: str) -> DataFrame:
    host = F.coalesce("host", F.lit(""))
    return table(spark, d, "docs").select("seq", text.classify(host, url.path(F.col("url")), F.col("title"), F.col("description")).alias("category"))


@query(
    "adult_gate",
    "SELECT DISTINCT host, regexp_matches(lower(host), '" + text.RULES[0][1].replace(".", "\\.") + "') OR regexp_matches(lower(host), '\\.(xxx|adult|porn|sex)$') AS adult FROM docs WHERE host IS NOT NULL",
)
def adult_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").where("host is not null").select("host", text.is_adult_host(F.col("host")).alias("adult")).distinct()


@query("excerpt_1200", "SELECT seq, left(body, 1200) AS excerpt FROM docs")
def excerpt_1200(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("seq", text.excerpt(F.col("body")).alias("excerpt"))


@query("squash_text", "SELECT seq, trim(regexp_replace(title, '[\\s\\x0b\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g')) AS squashed FROM docs")
def squash_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("seq", text.squash(F.col("title")).alias("squashed"))


@query("squash_capped")
def squash_capped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("seq", text.squash_bytes(F.col("body"), 300).alias("capped"))


@query(
    "query_terms",
    "SELECT seq, list_filter(list_transform(regexp_split_to_array(lower(title), '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')), lambda w: length(w) > 1) AS terms FROM docs WHERE title IS NOT NULL",
)
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").where("title is not null").select("seq", text.query_terms(F.col("title")).alias("terms"))


@query("sanitize_query", "SELECT seq, trim(regexp_replace(translate(title, '\"()[]{}^~:+-*!\\/', '                '), '\\s+', ' ', 'g')) AS clean FROM docs")
def sanitize_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("seq", text.sanitize_query(F.col("title")).alias("clean"))


@query(
    "format_numbers",
    """SELECT seq, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN CASE WHEN bytes / 1024.0 >= 100 THEN printf('%.0f', bytes / 1024.0) ELSE printf('%.1f', bytes / 1024.0) END || ' KB'
ELSE CASE WHEN bytes / 1048576.0 >= 100 THEN printf('%.0f', bytes / 1048576.0) ELSE printf('%.1f', bytes / 1048576.0) END || ' MB' END AS size FROM docs WHERE bytes < 1073741824""",
)
def format_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").where("bytes < 1073741824").select("seq", text.format_bytes(F.col("bytes")).alias("size"))


_FNV = """CASE WHEN h > 9223372036854775807 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END"""


@query(
    "fnv64_tokens",
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(translate(title, 'Σİ', 'σi')), '([\\p{{L}}\\p{{Nd}}]+)', 1)) AS token FROM docs),
x AS (SELECT token, list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(0, strlen(token)), lambda i: ('0x' || substr(hex(token), i * 2 + 1, 2))::UHUGEINT)),
lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM w)
SELECT token, {_FNV} AS fnv FROM x""",
)
def fnv64_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "docs").select(F.explode(hashing.tokens(F.col("title"))).alias("token")).distinct()
    return words.select("token", hashing.fnv64(F.col("token")).alias("fnv"))
