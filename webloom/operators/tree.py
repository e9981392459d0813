"""Per-key aggregation in which no reducer ever receives all partials of a hot key.

Method: *multi-level tree aggregation*.  Rows are cut into fixed-size input
chunks; each chunk is combined locally, then states are merged in rounds of
``FAN_IN`` chunks each, so a key that fills ``n`` chunks needs
``ceil(log(n) / log(FAN_IN))`` rounds and a task of round ``r`` receives at
most ``FAN_IN`` states of any one key (times one per map task of the round
before).  A key in few chunks is done after the first rounds and costs nothing
more.  Everything stays in JVM hash aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 16
#: Rows of one input chunk.
CHUNK_ROWS = 65_536
#: Share of all (batch, host) pairs from which a host counts as hot.
HOT_SHARE = 0.02


def host_key(host: Column) -> Column:
    """One spelling per host: lower case, trimmed, no trailing dot; null becomes ''."""
    return F.rtrim(F.lower(F.trim(F.coalesce(host, F.lit("")))), F.lit("."))


def tree_aggregate(df: DataFrame, keys: list[str], spread: list[str], first: dict[str, Column], merge: dict[str, str], rows: int) -> DataFrame:
    """Aggregate ``df`` by ``keys`` in rounds.

    ``spread`` are columns that together tell rows of one key apart, ``first``
    maps each output column to its aggregate over rows, ``merge`` to the name
    of the function that merges two states (``sum``, ``min``, ``max``), and
    ``rows`` is the number of rows, from which chunks and rounds follow.

    Null keys form one group.  An empty table gives an empty result.
    """
    chunks = max(1, math.ceil(rows / CHUNK_ROWS))
    rounds = math.ceil(math.log(chunks, FAN_IN)) if chunks > 1 else 0
    slots = FAN_IN**rounds
    state = df.withColumn("_chunk", F.pmod(F.xxhash64(*spread), F.lit(slots))).groupBy(*keys, "_chunk")
    state = state.agg(*(c.alias(n) for n, c in first.items()))
    for _ in range(rounds):
        state = state.withColumn("_chunk", F.floor(F.col("_chunk") / FAN_IN)).groupBy(*keys, "_chunk")
        state = state.agg(*(getattr(F, f)(n).alias(n) for n, f in merge.items()))
    return state.drop("_chunk")


def increments(hosts: DataFrame) -> DataFrame:
    """One row per batch and host, replays dropped.

    Replays are equal rows; should two rows of a batch and host differ, the
    larger counters and the wider time span hold.
    """
    counters = [F.max(c).alias(c) for c in ("pages", "errors", "bytes")]
    seen = [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    return hosts.select("batch", host_key(F.col("host")).alias("host"), "pages", "errors", "bytes", "first_seen", "last_seen").groupBy("batch", "host").agg(*counters, *seen)


def host_totals(hosts: DataFrame) -> DataFrame:
    """(host, batches, pages, errors, bytes, first_seen, last_seen) of every host.

    Null counters count as absent (a host with none sums to null); null hosts
    are the host ''.
    """
    first = {"batches": F.count("*")} | {c: F.sum(c) for c in ("pages", "errors", "bytes")}
    first |= {"first_seen": F.min("first_seen"), "last_seen": F.max("last_seen")}
    merge = {"batches": "sum", "pages": "sum", "errors": "sum", "bytes": "sum", "first_seen": "min", "last_seen": "max"}
    return tree_aggregate(increments(hosts), ["host"], ["batch"], first, merge, hosts.count())


def hot_hosts(hosts: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """Totals of the hosts with at least ``share`` of the distinct (batch, host) pairs."""
    totals = host_totals(hosts)
    everything = totals.agg(F.sum("batches").alias("_all"))
    return totals.join(F.broadcast(everything), F.col("batches") >= F.col("_all") * share).drop("_all")
