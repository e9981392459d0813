"""A line on exactly two neighbouring pages is shared on both."""

import pyarrow as pa

from webloom.llm import boilerplate
from webloom.llm.boilerplate import SHARED

BODIES = [
    "The ferry council met on Monday and rejected the plan.\nWe use cookies here",
    "A small bakery opened near the old depot in spring.\nWe use cookies here",
    "The night train stopped twice and nobody knew why.",
]


def pages(bodies, first=0):
    n = range(first, first + len(bodies))
    return pa.RecordBatch.from_pydict({"seq": list(n), "url": [f"http://a.example/{i}" for i in n], "title": [None] * len(bodies), "body": bodies})


def test_both_pages_of_a_pair_are_marked_across_batches():
    for batches in ([pages(BODIES)], [pages([b], i) for i, b in enumerate(BODIES)]):
        out = pa.Table.from_batches(boilerplate._differ(iter(batches))).to_pylist()
        shared = {(r["seq"], n) for r in out for n, b in enumerate(r["bits"]) if b & SHARED}
        assert shared == {(0, 1), (1, 1)} and sorted(r["seq"] for r in out) == [0, 1, 2]


def test_a_notice_on_two_pages_is_furniture(spark):
    rows = [(i, f"http://a.example/{i}", "a.example", None, b) for i, b in enumerate(BODIES)]
    df = spark.createDataFrame(rows, "seq long, url string, host string, title string, body string")
    got = {r["seq"]: r["furniture"] for r in boilerplate.furniture(df).collect()}
    assert got == {0: [2], 1: [2], 2: []}
