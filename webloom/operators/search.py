"""Full-text search: inverted index, BM25, query syntax, reranking and paging."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BOOSTS = {"title": 5.0, "description": 2.0, "host": 2.0, "body": 1.0}
TEXT_FIELDS = ("title", "description", "body")
MAX_TERM_BYTES = 40
RERANK_DEPTH, MAX_LIMIT, MAX_OFFSET = 600, 200, 10_000


def latest_by_url(docs: DataFrame) -> DataFrame:
    """The last document of every url (largest seq)."""
    return docs.join(docs.groupBy(F.col("url").alias("_u")).agg(F.max("seq").alias("_s")), (F.col("url") == F.col("_u")) & (F.col("seq") == F.col("_s")), "left_semi")


def analyze(text: Column) -> Column:
    """Words: split at other characters, lower case, at most 40 bytes."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(words, lambda w: F.octet_length(w) <= MAX_TERM_BYTES)


def field_words(docs: DataFrame) -> DataFrame:
    """(seq, field, words) of the text fields and the whole host."""
    parts = [F.struct(F.lit(f).alias("field"), analyze(F.col(f)).alias("words")) for f in TEXT_FIELDS]
    parts.append(F.struct(F.lit("host").alias("field"), F.array(F.coalesce("host", F.lit(""))).alias("words")))
    return docs.select("seq", F.explode(F.array(*parts)).alias("x")).select("seq", "x.*")


def postings(docs: DataFrame) -> DataFrame:
    """(field, term, seq, tf)."""
    return field_words(docs).select("field", "seq", F.explode("words").alias("term")).groupBy("field", "term", "seq").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(field, seq, dl)."""
    return field_words(docs).select("field", "seq", F.size("words").cast("long").alias("dl"))


@dataclass(frozen=True)
class Literal:
    """One word or phrase of a query: its terms, wanted field, and whether it must or must not match."""

    terms: tuple[str, ...]
    field: str | None = None
    must: bool = True
    negated: bool = False
    raw: str = ""  # as typed: a host matches only as a whole


_QUERY = re.compile(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|([^\s"()]+))|[()]')


def parse_query(text: str, conjunctive: bool = True) -> list[Literal]:
    """Words, "phrases", field:word, +must, -not, AND, OR, NOT; other syntax is taken as words."""
    out: list[Literal] = []
    negate, either = False, False
    for m in _QUERY.finditer(text):
        sign, field, phrase, word = m.groups()
        if word in ("AND", "OR", "NOT"):
            negate = word == "NOT"
            if word == "OR" and out:
                out[-1] = replace(out[-1], must=False)
                either = True
            continue
        terms = tuple(re.findall(r"[^\W_]+", (phrase or word or "").lower()))
        if not terms:
            continue
        if field and field not in BOOSTS:
            terms, field = (field.lower(), *terms), None
        must = (conjunctive and not either) or sign == "+"
        out.append(Literal(terms, field, must, negate or sign == "-", (phrase or word or "").lower()))
        negate = either = False
    return out


def _literal_scores(words: DataFrame, stats: DataFrame, i: int, lit: Literal, boosts: dict[str, float]) -> DataFrame:
    """(seq, i, score) of the documents a literal matches: BM25 of its rarest use per field, boosted and summed."""
    fields = [lit.field] if lit.field else list(boosts)
    in_field = words.where(F.col("field").isin(fields))
    if len(lit.terms) == 1:
        tf = F.size(F.filter("words", lambda w: w == lit.terms[0]))
    else:
        phrase = " ".join(lit.terms)
        joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
        tf = F.size(F.split(F.regexp_replace(joined, " ", "  "), re.escape(" " + phrase.replace(" ", "  ") + " "))) - 1
    whole_host = F.array_contains("words", lit.raw).cast("int")
    tf = F.when(F.col("field") == "host", whole_host).otherwise(tf)
    hits = in_field.select("seq", "field", F.size("words").alias("dl"), tf.alias("tf")).where("tf > 0")
    df = hits.groupBy("field").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl"))
    boost = F.lit(0.0)
    for f, w in boosts.items():
        boost = F.when(F.col("field") == f, w).otherwise(boost)
    scored = hits.join(F.broadcast(df), "field").join(F.broadcast(stats), "field")
    return scored.select("seq", (boost * idf * F.col("tf") * (K1 + 1) / norm).alias("s")).groupBy("seq").agg(F.sum("s").alias("score")).withColumn("i", F.lit(i))


def match(docs: DataFrame, literals: list[Literal], boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """(seq, score) of the documents that match: all must-literals, no negated one, any if none must."""
    words = field_words(docs)
    stats = words.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avg_dl"))
    wanted, banned = [x for x in literals if not x.negated], [x for x in literals if x.negated]
    if not wanted:
        found = docs.select("seq", F.lit(0.0).alias("score"))
    else:
        parts = None
        for i, lit in enumerate(wanted):
            one = _literal_scores(words, stats, i, lit, boosts)
            parts = one if parts is None else parts.unionByName(one)
        musts = [i for i, lit in enumerate(wanted) if lit.must]
        agg = parts.groupBy("seq").agg(F.sum("score").alias("score"), F.sum(F.col("i").isin(musts).cast("int") if musts else F.lit(0)).alias("_m"))
        found = agg.where(F.col("_m") == len(musts)).select("seq", "score")
    for i, lit in enumerate(banned):
        found = found.join(_literal_scores(words, stats, i, lit, boosts).select("seq"), "seq", "left_anti")
    return found


def quality(depth: Column, url: Column, title: Column, description: Column) -> Column:
    """Multiplier for shallow, short, described pages."""
    slashes = F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    out = (1 + 0.18 / (1 + depth)) * (1 + 0.10 / (1 + F.greatest(F.lit(0), slashes - 2)))
    return out * F.when(url.contains("?"), 0.94).otherwise(1.0) * F.when(empty(title), 0.75).otherwise(1.0) * F.when(empty(description), 0.95).otherwise(1.0)


@dataclass(frozen=True)
class SearchParams:
    query: str = ""
    category: str = ""
    host: str = ""
    lang: str = ""
    limit: int = 25
    offset: int = 0
    recent: bool = False
    title_boost: float | None = None


def filtered(docs: DataFrame, p: SearchParams) -> DataFrame:
    for column in ("category", "host", "lang"):
        if value := getattr(p, column).strip():
            docs = docs.where(F.col(column) == value)
    return docs


@dataclass
class SearchResult:
    hits: DataFrame
    total: int
    relaxed: bool


def search(docs: DataFrame, p: SearchParams) -> SearchResult:
    """Ranked hits of a query: strict first, any word if nothing matches all; filters do not score."""
    limit, offset = min(max(p.limit, 1), MAX_LIMIT), min(max(p.offset, 0), MAX_OFFSET)
    boosts = BOOSTS if p.title_boost is None else {"title": p.title_boost, "description": 1.0, "body": 1.0}
    kept = filtered(docs, p).select("seq")
    found = match(docs, parse_query(p.query), boosts).join(kept, "seq", "left_semi")
    total, relaxed = found.count(), False
    if not total and len(p.query.split()) > 1:
        loose = match(docs, parse_query(p.query, conjunctive=False), boosts).join(kept, "seq", "left_semi")
        if n := loose.count():
            found, total, relaxed = loose, n, True
    return SearchResult(rank(docs, found, limit, offset, p.recent), total, relaxed)


def rank(docs: DataFrame, found: DataFrame, limit: int, offset: int, recent: bool = False) -> DataFrame:
    """Top hits by time, or the best by score reranked by score share times quality."""
    rows = docs.join(found, "seq")
    if recent:
        return rows.select("seq", "url", "title", F.col("fetched_at").cast("double").alias("score")).orderBy(F.desc("score"), "url", "seq").offset(offset).limit(limit)
    depth = min(max((offset + limit) * 3, limit), RERANK_DEPTH)
    top = rows.orderBy(F.desc("score"), "url", "seq").limit(depth)
    best = found.agg(F.greatest(F.max("score"), F.lit(0.001)).alias("_best"))
    key = F.col("score") / F.col("_best") * quality(F.col("depth"), F.col("url"), F.col("title"), F.col("description"))
    keyed = top.join(F.broadcast(best)).withColumn("key", key)
    return keyed.orderBy(F.desc("key"), F.desc("score"), "url", "seq").offset(offset).limit(limit).select("seq", "url", "title", "score", "key")


def index_stats(docs: DataFrame, cursor: int) -> DataFrame:
    """(documents, indexed, pending): documents, those up to the cursor, and those after it."""
    return docs.agg(
        F.count("*").alias("documents"), F.sum((F.col("seq") <= cursor).cast("long")).alias("indexed"), F.sum((F.col("seq") > cursor).cast("long")).alias("pending")
    )


def spool(docs: DataFrame, after: int, n: int = 500) -> DataFrame:
    """Documents after a sequence number, ascending, at most ``n`` (5000)."""
    return docs.where(F.col("seq") > after).orderBy("seq").limit(min(n if n > 0 else 500, 5000))


def empty_hits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "seq long, url string, title string, score double, key double")
