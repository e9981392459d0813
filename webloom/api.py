"""The engine's functions over a set of tables: what a dashboard or client asks for, and the maintenance actions.

``Store`` holds the tables of one crawl as DataFrames; actions return a new
``Store`` and change nothing in place, so a caller writes back what it wants
to keep.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.config import Config
from webloom.operators import dedup, frontier, outcome, rollup, search
from webloom.operators.tree import host_key
from webloom.sources.readers import with_scheme

URL_STATE = "url string, state int, done_at long"
FRONTIER = "url string, host string, depth long"
FINGERPRINTS = "url string, fp long"
ROBOTS = "host string, body string, fetched_at long, ok boolean"


@dataclass(frozen=True)
class Store:
    events: DataFrame
    docs: DataFrame
    url_state: DataFrame
    queue: DataFrame
    leased: DataFrame
    fingerprints: DataFrame
    robots: DataFrame
    config: Config = Config()
    running: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.events.sparkSession


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


# --- reading


def pages(fetches: DataFrame, max_bytes: int) -> DataFrame:
    """Fetched pages (url, status, content_type, body): bodies of non-HTML and failed fetches dropped, others cut at the size cap."""
    keep = outcome.is_html(F.col("content_type")) & (F.col("status") < 400)
    size = F.octet_length("body")
    return fetches.withColumn("truncated", keep & (size > max_bytes)).withColumn("body", F.when(keep, F.left("body", F.lit(max_bytes))))


def health(store: Store) -> dict:
    return {"running": store.running, "paused": store.config.paused, "workers": store.config.workers}


def stats(store: Store, now: int) -> DataFrame:
    """(k, v) of the tiles: totals, hosts, queue, spool, success share in per mille."""
    events = rollup.distinct_events(store.events)
    totals = rollup.totals(events)
    hosts = events.agg(F.countDistinct("host").alias("v")).select(F.lit("hosts").alias("k"), "v")
    queue = store.queue.agg(F.count("*").alias("v")).select(F.lit("queue").alias("k"), "v")
    leased = store.leased.agg(F.count("*").alias("v")).select(F.lit("leased").alias("k"), "v")
    minute = events.where(F.col("sec").between(now - 60, now - 1)).agg(F.sum(F.col("ok").cast("long")).alias("v")).select(F.lit("pages_per_min").alias("k"), F.coalesce("v", F.lit(0)).alias("v"))
    share = events.agg((F.avg(F.col("ok").cast("double")) * 1000).cast("long").alias("v")).select(F.lit("success_permille").alias("k"), F.coalesce("v", F.lit(0)).alias("v"))
    out = totals
    for part in (hosts, queue, leased, minute, share):
        out = out.unionByName(part)
    return out


def snapshot(store: Store, now: int) -> dict[str, DataFrame]:
    """All panels of the dashboard."""
    events = rollup.distinct_events(store.events)
    top = lambda df, n: df.orderBy(F.desc("n"), "label").limit(n)
    minutes = rollup.series(events, 60)
    return {
        "stats": stats(store, now),
        "hosts": hosts(store, 25),
        "categories": rollup.label_counts(events, "category").orderBy(F.desc("n"), "label"),
        "langs": top(rollup.label_counts(events, "lang"), 12),
        "countries": top(rollup.label_counts(events, "country"), 30),
        "statuses": rollup.status_counts(events).orderBy(F.desc("n"), "status"),
        "minutes": rollup.fill_grid(minutes, now - now % 60 - 59 * 60, now - now % 60, 60, ["pages", "bytes", "errors"]),
        "recent": rollup.recent(events),
    }


def hosts(store: Store, n: int = 50) -> DataFrame:
    return rollup.host_rollup(rollup.distinct_events(store.events)).orderBy(F.desc("pages"), "host").limit(n if n > 0 else 10)


def recent(store: Store, n: int = 60) -> DataFrame:
    return rollup.recent(rollup.distinct_events(store.events), n)


def pings(store: Store) -> DataFrame:
    """(seq, host, before): each event of the last 400 with the host of the one before it."""
    from pyspark.sql import Window as W

    last = recent(store, 400).select("seq", "host")
    return last.withColumn("before", F.lag("host").over(W.orderBy("seq")))


def queue_size(store: Store, most: int) -> tuple[int, bool]:
    """Queue length counted up to ``most``, and whether it is exact."""
    n = store.queue.select("url").limit(most + 1).count()
    return min(n, most), n <= most


def spool(store: Store, after: int, n: int = 500) -> DataFrame:
    return search.spool(store.docs, after, n)


def find(store: Store, params: search.SearchParams) -> search.SearchResult:
    return search.search(search.latest_by_url(store.docs), params)


# --- writing


def add_seeds(store: Store, urls: list[str]) -> tuple[Store, int, int]:
    """Store with the new urls queued at depth 0, how many were added, how many were given."""
    if not urls:
        return store, 0, 0
    given = store.spark.createDataFrame([(u.strip(), i) for i, u in enumerate(urls)], "url string, pos int").where("url <> ''")
    cand = given.select(with_scheme(F.col("url")).alias("url"), F.lit(0).cast("long").alias("depth"))
    new = frontier.enqueue(cand, store.url_state)
    state = store.url_state.unionByName(new.select("url", F.lit(frontier.PENDING).alias("state"), F.lit(0).cast("long").alias("done_at")))
    return replace(store, queue=store.queue.unionByName(new), url_state=state), new.count(), len(urls)


def take(store: Store, n: int) -> tuple[Store, DataFrame]:
    """Lease the first ``n`` items: they leave the queue until completed or swept."""
    leased = frontier.lease(store.queue, n).select("url", "host", "depth")
    return replace(store, queue=store.queue.join(leased.select("url"), "url", "left_anti").select("url", "host", "depth"), leased=store.leased.unionByName(leased)), leased


def sweep(store: Store) -> Store:
    """Leases go back to the end of the queue, as after a restart."""
    back = store.leased.select("url", "host", F.lit(frontier.LAST_PRIORITY).cast("long").alias("depth"))
    return replace(store, queue=store.queue.unionByName(back), leased=store.leased.limit(0))


def complete(store: Store, results: DataFrame) -> Store:
    """A batch of results (url, state, done_at, retry, depth, links, doc): seen-set, leases, links and documents in one step.

    Retried urls go back to the queue and do nothing else; documents near one
    already committed are dropped, their links kept.
    """
    done = results.where("not retry")
    again = results.where("retry").select("url", frontier.key_host(F.col("url")).alias("host"), F.lit(frontier.LAST_PRIORITY).cast("long").alias("depth"))
    state = frontier.complete(done, store.url_state)
    links = outcome.harvest(done.select("links", "depth"), store.config.max_depth, store.config.crawl_adult).select("url", F.col("depth").cast("long").alias("depth"))
    new = frontier.enqueue(links, state)
    state = state.unionByName(new.select("url", F.lit(frontier.PENDING).alias("state"), F.lit(0).cast("long").alias("done_at")))
    docs = done.where("doc is not null").select("doc.*")
    kept = dedup.suppress(docs, store.fingerprints) if store.config.dedup_near_duplicates else docs
    fps = dedup.fingerprints(kept).select("url", "fp").dropDuplicates(["url"])
    return replace(
        store,
        url_state=state,
        leased=store.leased.join(results.select("url"), "url", "left_anti").select("url", "host", "depth"),
        queue=store.queue.unionByName(new).unionByName(again),
        docs=store.docs.unionByName(kept.select(store.docs.columns)),
        fingerprints=dedup.upsert(store.fingerprints, fps),
    )


def control(store: Store, action: str) -> Store:
    """Maintenance: start, stop, pause, resume, clear-queue, clear-seen, clear-robots, reset-stats, forget-duplicates, reseed."""
    spark = store.spark
    actions = {
        "start": lambda: replace(sweep(store), running=True),
        "stop": lambda: replace(sweep(store), running=False),
        "pause": lambda: replace(store, config=replace(store.config, paused=True)),
        "resume": lambda: replace(store, config=replace(store.config, paused=False)),
        "clear-queue": lambda: replace(store, queue=empty(spark, FRONTIER), leased=empty(spark, FRONTIER)),
        "clear-seen": lambda: replace(store, url_state=empty(spark, URL_STATE)),
        "clear-robots": lambda: replace(store, robots=empty(spark, ROBOTS)),
        "reset-stats": lambda: replace(store, events=store.events.limit(0)),
        "forget-duplicates": lambda: replace(store, fingerprints=empty(spark, FINGERPRINTS)),
        "reseed": lambda: replace(store, queue=store.queue.unionByName(frontier.recrawl_due(store.url_state, 1 << 62, 20_000).select("url", "host", F.col("depth").cast("long").alias("depth")))),
    }
    if action not in actions:
        raise ValueError(f"unknown action {action!r}")
    return actions[action]()


def top_up(store: Store, now: int) -> Store:
    """Queue urls that are due again, by the recrawl policy."""
    waiting = store.queue.limit(200_001).count() + store.leased.limit(200_001).count()
    plan = frontier.recrawl_policy(waiting, store.config.recrawl_after_hours, now)
    if plan is None:
        return store
    due = frontier.recrawl_due(store.url_state, *plan).select("url", "host", F.col("depth").cast("long").alias("depth"))
    pending = due.select("url").withColumn("_p", F.lit(True))
    state = store.url_state.join(pending, "url", "left").select("url", F.when(F.col("_p"), frontier.PENDING).otherwise(F.col("state")).cast("int").alias("state"), "done_at")
    return replace(store, queue=store.queue.unionByName(due), url_state=state)


def discovery_due(config: Config, last_run: int, now: int, forced: bool = False) -> bool:
    """Discovery runs when forced, or enabled and its interval has passed."""
    return forced or (config.discovery_enabled and now - last_run >= config.discovery_interval_min * 60)


def discover(store: Store, sources: list[DataFrame]) -> tuple[Store, int]:
    """Urls of the sources (url, pos), in order and within the cycle's budget, queued if new."""
    if not sources:
        return store, 0
    found = frontier.ordered_union(sources, store.config.discovery_max_per_cycle)
    before = found.select("url", F.lit(0).cast("long").alias("depth"))
    new = frontier.enqueue(before, store.url_state)
    state = store.url_state.unionByName(new.select("url", F.lit(frontier.PENDING).alias("state"), F.lit(0).cast("long").alias("done_at")))
    return replace(store, queue=store.queue.unionByName(new), url_state=state), new.count()


def fresh_events(store: Store, after: int, n: int = 200) -> DataFrame:
    """Newest events after a sequence number for a live feed, at most ``n`` (200)."""
    return store.events.withColumn("host", host_key(F.col("host"))).where(F.col("seq") > after).orderBy(F.desc("seq")).limit(min(n, 200))


def alert_messages(alerts: DataFrame) -> list[dict]:
    """Payloads of the sent alerts (kind, ts); sending them is the caller's part."""
    text = {"stall": "No page was fetched for ten minutes.", "errors": "More than half of the fetches fail.", "disk": "The store is over its size limit."}
    return [{"kind": r["kind"], "ts": r["ts"], "text": text.get(r["kind"], r["kind"])} for r in alerts.orderBy("ts", "kind").collect()]
