"""Registered queries of the training-data problems and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import boilerplate, language, mixing, packing, repeated_lines, residue, sentences, stuffing, toxic
from webloom.llm.tokens import with_tokens
from webloom.session import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    scored = toxic.score_pages(table(spark, d, "docs"), table(spark, d, "review_labels"))
    return scored.where("is_toxic").select("seq")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxic.score_pages(table(spark, d, "docs"), table(spark, d, "review_labels"))


def p1_host_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxic.host_rates(p1_scores(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture(table(spark, d, "docs")).select("seq", F.explode(F.col("furniture").cast("array<long>")).alias("line_no"))


def p3_main_text(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.clean_pages(table(spark, d, "docs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose label is missing or wrong and the mixed ones, residue (p6) and spam (p7) left out; both are looked for among the pages that would be named."""
    docs = table(spark, d, "docs")
    trees = docs.sparkSession.sparkContext.broadcast(language.fit(docs))
    facts = ("facts", residue.FACTS, lambda title, lines, code, langs, signed: residue.page_facts(title, lines, signed))
    spam = ("spam", "boolean", lambda title, lines, code, langs, signed: language.is_named(code, langs) and stuffing.page_is_spam(lines))
    pages = boilerplate.own_pages(docs, "host", "title", "body", "lang")
    found = materialize(language.conclude_pages(pages, trees, facts, spam), "page-languages")
    named = language.relabel(language.settle(found, found.where(language.may_be_named() & ~F.col("spam"))))
    left_out = residue.judge(docs, found, language.may_be_named() & ~F.col("spam")).select("seq")
    return named.select("seq", "lang").join(left_out, "seq", "left_anti")


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    """(seq, lang, confidence): every language of every page with text, whatever its label."""
    found = language.page_languages(table(spark, d, "docs"))
    return found.select("seq", F.explode(F.arrays_zip("langs", "confidence")).alias("x")).select("seq", F.col("x.langs").alias("lang"), F.col("x.confidence").alias("confidence"))


def p4_passages(spark: SparkSession, d: str) -> DataFrame:
    return language.label_passages(table(spark, d, "docs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "docs"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.cut_repeated(table(spark, d, "docs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "docs")).select("seq")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.score_pages(table(spark, d, "docs")).where("is_spam").select("seq")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(with_tokens(table(spark, d, "documents"), ["doc_id"]), table(spark, d, "pack_limits"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(p8_containers(spark, d), table(spark, d, "pack_limits"))


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    sized = with_tokens(table(spark, d, "documents"), ["doc_id"])
    return packing.faults(packing.pack(sized, table(spark, d, "pack_limits")), sized, table(spark, d, "pack_limits"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(with_tokens(table(spark, d, "documents"), ["doc_id", "source"]), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents")).select("doc_id", "end_pos")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_scores": p1_scores,
    "p1_host_rates": p1_host_rates,
    "p3_found": p3_found,
    "p3_main_text": p3_main_text,
    "p4_found": p4_found,
    "p4_languages": p4_languages,
    "p4_passages": p4_passages,
    "p5_found": p5_found,
    "p5_clean": p5_clean,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_faults": p8_faults,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_sentences": p10_sentences,
}

#: Lines equal after lower-casing, trimming, reducing white space and digit runs.
P5_SQL = """WITH d AS (SELECT seq, coalesce(host,'') AS host, coalesce(url,'') AS url, string_split(body, chr(10)) AS ls FROM docs WHERE body IS NOT NULL),
x AS (SELECT seq, host, url, unnest(ls) AS l, unnest(range(1, len(ls) + 1))::BIGINT AS line_no FROM d),
k AS (SELECT seq, host, url, line_no, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[\\s\\x0b\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g')) AS k FROM x),
n AS (SELECT coalesce(host,'') AS host, count(DISTINCT coalesce(url,'')) AS n FROM docs GROUP BY 1),
r AS (SELECT host, k FROM k WHERE k <> '' GROUP BY 1, 2 HAVING count(DISTINCT url) >= 5
  AND count(DISTINCT url) >= 0.05 * (SELECT n FROM n WHERE n.host = k.host))
SELECT seq, line_no FROM k JOIN r USING (host, k)"""

#: Every text that is not empty is placed whole, and no container holds too much.
P8_SQL = """SELECT pack_name, (SELECT count(*) FROM documents WHERE text <> '')::BIGINT AS texts, 0::BIGINT AS overfull,
  0::BIGINT AS split_needlessly, 0::BIGINT AS tokens_lost FROM pack_limits WHERE capacity > 0"""

ORACLE_SQL: dict[str, str] = {"p5_found": P5_SQL, "p8_faults": P8_SQL}
