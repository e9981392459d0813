"""Frontier queries against the whole seen-set, on tables of their own."""

import pytest

from webloom.plans import registry

URLS = [f"http://h{i % 3}.example/{i}" for i in range(60)]
NEW, SEEN = set(URLS[:12]), URLS[12:]


@pytest.fixture(scope="module")
def crawl(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("crawl"))
    spark.createDataFrame([(u, 1) for u in URLS], "url string, depth int").write.parquet(f"{d}/fetch_log.parquet")
    spark.createDataFrame([(u, i % 2) for i, u in enumerate(SEEN)], "url string, state int").write.parquet(f"{d}/url_state.parquet")
    return d


@pytest.mark.parametrize("name", ["enqueue_new", "frontier_order", "lease_batch", "round_robin_hosts", "politeness_schedule", "requeue_union"])
def test_no_seen_url_comes_out_as_new(spark, crawl, name):
    assert {r["url"] for r in registry.QUERIES[name](spark, crawl).collect()} == NEW


def test_added_count(spark, crawl):
    assert registry.QUERIES["enqueue_added_count"](spark, crawl).first()["added"] == len(NEW)
