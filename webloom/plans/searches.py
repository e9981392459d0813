"""Full-text search queries over ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import text
from webloom.operators import search
from webloom.operators.search import SearchParams
from webloom.plans.base import query
from webloom.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs")


_WORDS = "list_filter(regexp_extract_all(lower(coalesce({},'')), '([\\p{{L}}\\p{{N}}]+)', 1), lambda w: strlen(w) <= 40)"
_FIELDS = f"""fw AS (SELECT seq, 'title' AS field, {_WORDS.format('title')} AS words FROM docs UNION ALL SELECT seq, 'description', {_WORDS.format('description')} FROM docs
UNION ALL SELECT seq, 'body', {_WORDS.format('body')} FROM docs UNION ALL SELECT seq, 'host', [coalesce(host,'')] FROM docs)"""


def _score_sql(words: list[str], need: int, where: str = "true") -> str:
    terms = ",".join(f"('{w}')" for w in words)
    return f"""{_FIELDS}, q(term) AS (VALUES {terms}), st AS (SELECT field, count(*) AS n, avg(len(words)) AS av FROM fw GROUP BY 1),
tf AS (SELECT seq, field, term, len(words) AS dl, len(list_filter(words, lambda w: w = term)) AS tf FROM fw, q WHERE list_contains(words, term)),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY 1, 2),
s AS (SELECT tf.seq, tf.term, (CASE tf.field WHEN 'title' THEN 5.0 WHEN 'description' THEN 2.0 WHEN 'host' THEN 2.0 ELSE 1.0 END) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2
/ (tf.tf + 1.2 * (1 - 0.75 + 0.75 * dl / av)) AS score FROM tf JOIN df ON df.field = tf.field AND df.term = tf.term JOIN st ON st.field = tf.field),
hit AS (SELECT seq, sum(score) AS score FROM s GROUP BY seq HAVING count(DISTINCT term) >= {need}),
f AS (SELECT d.seq, d.url, d.title, d.description, d.depth, d.fetched_at, d.body, score FROM hit JOIN docs d USING (seq) WHERE {where})"""


_QUALITY = """(1 + 0.18 / (1 + depth))::DOUBLE * (1 + 0.10 / (1 + greatest(0, length(url) - length(replace(url,'/','')) - 2))) * CASE WHEN contains(url,'?') THEN 0.94 ELSE 1 END
* CASE WHEN coalesce(title,'') = '' THEN 0.75 ELSE 1 END * CASE WHEN coalesce(description,'') = '' THEN 0.95 ELSE 1 END"""


def _hits(result: search.SearchResult) -> DataFrame:
    return result.hits.select("seq", "url", F.round("score", 4).alias("score"))


@query("postings", f"WITH {_FIELDS} SELECT field, term, seq, count(*)::BIGINT AS tf FROM (SELECT field, seq, unnest(words) AS term FROM fw) GROUP BY 1, 2, 3")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(_docs(spark, d))


@query("doc_lengths", f"WITH {_FIELDS} SELECT field, seq, len(words)::BIGINT AS dl FROM fw")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return search.doc_lengths(_docs(spark, d))


@query("search_strict", f"WITH {_score_sql(['harbour', 'council'], 2)} SELECT seq, round(score, 4) AS score FROM f")
def search_strict(spark: SparkSession, d: str) -> DataFrame:
    return search.match(_docs(spark, d), search.parse_query("harbour council")).select("seq", F.round("score", 4).alias("score"))


@query("search_relaxed", f"WITH {_score_sql(['harbour', 'pickle', 'zzzz'], 1)} SELECT seq, round(score, 4) AS score FROM f")
def search_relaxed(spark: SparkSession, d: str) -> DataFrame:
    return search.match(_docs(spark, d), search.parse_query("harbour pickle zzzz", conjunctive=False)).select("seq", F.round("score", 4).alias("score"))


@query("search_filtered", f"WITH {_score_sql(['harbour'], 1, chr(34) + 'category' + chr(34) + chr(61) + chr(39) + 'news' + chr(39))} SELECT seq, round(score, 4) AS score FROM f")
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    kept = search.filtered(docs, SearchParams(category=" news ")).select("seq")
    return search.match(docs, search.parse_query("harbour")).join(kept, "seq", "left_semi").select("seq", F.round("score", 4).alias("score"))


@query("search_phrase", f"WITH {_FIELDS} SELECT DISTINCT seq FROM fw WHERE contains(' ' || array_to_string(words,' ') || ' ', ' harbour council ')")
def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return search.match(_docs(spark, d), search.parse_query('"harbour council"')).select("seq")


@query("search_negated", f"WITH {_score_sql(['harbour'], 1)}, b AS (SELECT DISTINCT seq FROM fw WHERE list_contains(words, 'council')) SELECT seq, round(score, 4) AS score FROM f WHERE seq NOT IN (SELECT seq FROM b)")
def search_negated(spark: SparkSession, d: str) -> DataFrame:
    return search.match(_docs(spark, d), search.parse_query("harbour -council")).select("seq", F.round("score", 4).alias("score"))


@query("search_recent", f"WITH {_score_sql(['harbour'], 1)} SELECT seq, url, round(fetched_at::DOUBLE, 4) AS score FROM f ORDER BY fetched_at DESC, url, seq LIMIT 25")
def search_recent(spark: SparkSession, d: str) -> DataFrame:
    return _hits(search.search(_docs(spark, d), SearchParams("harbour", recent=True)))


_RERANK = f"""top AS (SELECT * FROM f ORDER BY score DESC, url, seq LIMIT {{depth}}), k AS (SELECT *, score / greatest((SELECT max(score) FROM f), 0.001) * {_QUALITY} AS key FROM top)
SELECT seq, url, round(score, 4) AS score FROM k ORDER BY key DESC, score DESC, url, seq LIMIT {{limit}} OFFSET {{offset}}"""


@query("search_rerank", f"WITH {_score_sql(['harbour', 'council'], 2)}, " + _RERANK.format(depth=75, limit=25, offset=0))
def search_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _hits(search.search(_docs(spark, d), SearchParams("harbour council")))


@query("search_paged", f"WITH {_score_sql(['harbour', 'council'], 2)}, " + _RERANK.format(depth=90, limit=10, offset=20))
def search_paged(spark: SparkSession, d: str) -> DataFrame:
    return _hits(search.search(_docs(spark, d), SearchParams("harbour council", limit=10, offset=20)))


@query("search_count", f"WITH {_score_sql(['harbour', 'council'], 2)} SELECT count(*)::BIGINT AS total, false AS relaxed FROM f")
def search_count(spark: SparkSession, d: str) -> DataFrame:
    result = search.search(_docs(spark, d), SearchParams("harbour council"))
    return spark.createDataFrame([(result.total, result.relaxed)], "total long, relaxed boolean")


@query("search_diagnostic")
def search_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    return _hits(search.search(_docs(spark, d), SearchParams("harbour council", limit=10, title_boost=4.0)))


@query("search_all", "SELECT seq FROM docs")
def search_all(spark: SparkSession, d: str) -> DataFrame:
    """No words and no filters: every document."""
    return search.match(_docs(spark, d), []).select("seq")


@query("search_snippets")
def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    found = docs.join(search.match(docs, search.parse_query("harbour council")).select("seq"), "seq")
    terms = text.query_terms(F.lit("harbour council"))
    return found.select("seq", text.snippet(F.col("description"), text.excerpt(F.col("body")), terms).alias("snippet"))


@query("search_highlight", """SELECT seq, regexp_replace(replace(replace(replace(replace(title,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;'), '(harbour|council)', '<mark>\\1</mark>', 'gi') AS html FROM docs WHERE title IS NOT NULL""")
def search_highlight(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("title is not null").select("seq", text.highlight(F.col("title"), ["harbour", "council"]).alias("html"))


@query("quality_multiplier", f"SELECT seq, floor(({_QUALITY})::DOUBLE * 10000 + 0.25)::BIGINT AS quality_e4 FROM docs")
def quality_multiplier(spark: SparkSession, d: str) -> DataFrame:
    q = search.quality(F.col("depth"), F.col("url"), F.col("title"), F.col("description"))
    return _docs(spark, d).select("seq", F.floor(q * 10000 + 0.25).alias("quality_e4"))


@query("index_stats", "SELECT count(*)::BIGINT AS documents, count(*) FILTER (WHERE seq <= 500)::BIGINT AS indexed, count(*) FILTER (WHERE seq > 500)::BIGINT AS pending FROM docs")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.index_stats(_docs(spark, d), 500)
