"""Repeated chunks are counted by distinct urls, recrawls not counted again."""

from webloom.llm import repeated_lines

COLUMNS = "seq long, url string, host string, body string"


def test_recrawls_do_not_make_a_chunk_repeated(spark):
    own = [f"Own words of page {chr(97 + i)}" for i in range(8)]
    lines = {i: [own[i], "On every page"] + (["words: ada byron"] if i < 4 else []) for i in range(8)}
    pages = [(i, f"http://a.example/{i}", "a.example", "\n".join(lines[i])) for i in range(8)]
    pages += [(10 + i, f"http://a.example/{i}", "a.example", "\n".join(lines[i])) for i in range(4)]
    clean = {r["seq"]: r["clean_body"] for r in repeated_lines.cut_repeated(spark.createDataFrame(pages, COLUMNS)).collect()}
    assert clean[0] == clean[10] == own[0] + "\nwords: ada byron" and clean[7] == own[7]
