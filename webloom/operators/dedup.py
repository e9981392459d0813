"""Near-duplicate suppression by SimHash fingerprints: cells of pairs within one table, quarters against a committed one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.hashing import NEAR_BITS, fingerprint, is_near
from webloom.session import materialize


def fingerprints(docs: DataFrame) -> DataFrame:
    """(seq, url, fp) of title, description and body."""
    text = F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in ("title", "description", "body")))
    return docs.select("seq", "url", fingerprint(text).alias("fp"))


def classes(fps: DataFrame) -> DataFrame:
    """(fp, first_seq, members): one row per distinct fingerprint; equal ones need no comparison with each other."""
    return fps.where("fp <> 0").groupBy("fp").agg(F.min("seq").alias("first_seq"), F.count("*").alias("members"))


#: Number of 16-bit quarters of a fingerprint.
_QUARTERS = 4
_NO_FLIP, _ONE_FLIP = [0], [0, *(1 << i for i in range(16))]
_TWO_FLIPS = [*_ONE_FLIP, *((1 << i) | (1 << j) for i in range(16) for j in range(i))]


def _keyed(df: DataFrame, fp: str, flips: list[int]) -> DataFrame:
    """``df`` with (q, v): each 16-bit quarter of the fingerprint, as it is and with the given bits flipped."""
    quarter = lambda i: F.shiftright(fp, 16 * i).bitwiseAND(F.lit(65535)).cast("int")
    masks = F.array(*(F.lit(f) for f in flips))

    def keys_of(i: int) -> Column:
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("q"), quarter(i).bitwiseXOR(m).alias("v")))

    keys = [keys_of(i) for i in range(_QUARTERS)]
    return df.select("*", F.explode(F.concat(*keys)).alias("_x")).select(*df.columns, "_x.q", "_x.v")


#: A block of fingerprints holds about as many at least; more fingerprints make more blocks, then larger ones, then more again as a cell is read whole.
_BLOCK, _BLOCKS, _LARGEST = 1 << 14, 32, 1 << 21
#: Fingerprints that one is compared with at once (they stay in the cache), and near pairs handed on together.
_AT_ONCE, _HANDED = 1 << 15, 1 << 18


def _cells(known: DataFrame) -> DataFrame:
    """Rows of ``known`` (fp and more) with (cell, within, second), repartitioned by cell: fingerprints fall into blocks, a cell is a pair of blocks.

    Any two rows meet in one cell: that of their block (``within``), or that of
    their two blocks (``second`` tells the one from the other).
    """
    n = known.count()
    blocks = max(1, min(_BLOCKS, -(-n // _BLOCK)), -(-n // _LARGEST))
    block, other = F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
    cell, within = F.least("_block", "_other") * blocks + F.greatest("_block", "_other"), F.col("_block") == F.col("_other")
    rows = known.select("*", block).select("*", other).select(*known.columns, cell.alias("cell"), within.alias("within"), (F.col("_block") > F.col("_other")).alias("second"))
    return rows.repartition(blocks * (blocks + 1) // 2, "cell")


def _near(a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of near pairs of ``a`` with ``b``, or within ``a``, that share a byte band; every pair is looked at."""
    within = b is None
    b = a if within else b
    xor, bits, near = np.empty(_AT_ONCE, np.uint64), np.empty(_AT_ONCE, np.uint8), np.empty(_AT_ONCE, bool)
    for start in range(0, len(b), _AT_ONCE):
        some, rows, found, held = b[start : start + _AT_ONCE], [], [], 0
        last = min(len(a), start + len(some)) if within else len(a)
        for i in range(last):
            skip = max(0, i + 1 - start) if within else 0
            part = some[skip:]
            x, k, hit = xor[: len(part)], bits[: len(part)], near[: len(part)]
            np.less_equal(np.bitwise_count(np.bitwise_xor(part, a[i], out=x), out=k), NEAR_BITS, out=hit)
            at = hit.nonzero()[0]
            if len(at):
                rows.append(i)
                found.append(at + (start + skip))
                held += len(at)
            if found and (held >= _HANDED or i == last - 1):
                left, right = np.repeat(np.array(rows), [len(x) for x in found]), np.concatenate(found)
                differ = a[left] ^ b[right]
                banded = ~differ.view(np.uint8).reshape(-1, 8).all(axis=1)
                yield left[banded], right[banded], np.bitwise_count(differ[banded])
                rows, found, held = [], [], 0


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray | None]:
    """Both sides of a cell and their fingerprints; the second side is None if the cell is one block."""
    cell = pa.Table.from_batches(list(batches))
    second = cell["second"].to_numpy()
    one, two = cell.filter(~second), cell.filter(second)
    bits = lambda t: np.ascontiguousarray(t["fp"].to_numpy()).view(np.uint64)
    return one, two, bits(one), None if cell["within"][0].as_py() else bits(two)


_LAST = (1 << 63) - 1


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, two, a, b = _read(batches)
    sides = [one] if b is None else [one, two]
    first = [t["first_seq"].to_numpy() for t in sides]
    links, before = [np.zeros(len(x), np.int64) for x in first], [np.full(len(x), _LAST) for x in first]
    for i, j, _ in _near(a, b):
        for k, m, here, there in ((0, -1, i, j), (-1, 0, j, i)):
            links[k] += np.bincount(here, minlength=len(links[k]))
            np.minimum.at(before[k], here, first[m][there])
    for t, n, earliest in zip(sides, links, before):
        linked = n > 0
        yield pa.RecordBatch.from_pydict({"fp": t["fp"].to_numpy()[linked], "n_links": n[linked], "before": earliest[linked]})


def near_links(known: DataFrame) -> DataFrame:
    """(fp, n_links, before) of fingerprints with near ones: how many there are, and the least ``first_seq`` of these.

    The pairs, which may be many more than the documents, are counted where they
    are found and never written.  ``known`` is read twice: pass a materialised table.
    """
    rows = known.select("fp", F.coalesce(F.col("first_seq").cast("long"), F.lit(_LAST)).alias("first_seq"))
    found = _cells(rows).groupBy("cell").applyInArrow(_cell_links, "fp long, n_links long, before long")
    return found.groupBy("fp").agg(F.sum("n_links").alias("n_links"), F.min("before").alias("before"))


def _cell_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, two, a, b = _read(batches)
    left = one["fp"].to_numpy()
    right = left if b is None else two["fp"].to_numpy()
    for i, j, distance in _near(a, b):
        x, y = left[i], right[j]
        yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y), "distance": distance.astype(np.int32)})


def near_pairs(fps: DataFrame) -> DataFrame:
    """(a, b, distance) of distinct fingerprints that share a byte band and differ in at most eight bits, a < b.

    Any two fingerprints meet in one cell, so no pair is lost and none comes out twice.
    ``fps`` is read several times: pass a materialised table.
    """
    return _cells(classes(fps).select("fp")).groupBy("cell").applyInArrow(_cell_pairs, "a long, b long, distance int")


def shares_band(a, b):
    """True if any of the eight bytes is equal."""
    x = a.bitwiseXOR(b)
    out = F.lit(False)
    for i in range(8):
        out = out | (F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)) == 0)
    return out


def near_dup_flags(fps: DataFrame) -> DataFrame:
    """(seq, fp, class_seq, is_copy, n_links): each document with its class, whether an earlier neighbour exists, and the links of its class.

    ``fps`` is read several times: pass a materialised table.
    """
    known = materialize(classes(fps), "classes")
    links = near_links(known)
    out = fps.join(known.select("fp", "first_seq"), "fp", "left").join(links, "fp", "left")
    copy = F.coalesce((F.col("seq") > F.col("first_seq")) | (F.col("before") < F.col("seq")), F.lit(False))
    return out.select("seq", "fp", F.coalesce("first_seq", "seq").alias("class_seq"), copy.alias("is_copy"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def suppress(docs: DataFrame, committed: DataFrame) -> DataFrame:
    """Documents without a near neighbour of another url among the committed fingerprints (url, fp).

    The quarters of the batch are looked up with up to two bits flipped, those
    of the committed ones, which are many, as they are.
    """
    fps = fingerprints(docs)
    new = _keyed(fps.select("seq", F.col("url").alias("u"), "fp").where("fp <> 0"), "fp", _TWO_FLIPS)
    old = _keyed(committed.select("url", F.col("fp").alias("f")).where("f <> 0"), "f", _NO_FLIP)
    near = (F.col("u") != F.col("url")) & is_near(F.col("fp"), F.col("f")) & shares_band(F.col("fp"), F.col("f"))
    hit = new.join(old, ["q", "v"]).where(near).select("seq").distinct()
    return docs.join(hit, "seq", "left_anti")


def upsert(committed: DataFrame, new: DataFrame) -> DataFrame:
    """Fingerprints keyed by url, new ones replacing old."""
    return committed.join(new.select("url"), "url", "left_anti").unionByName(new.select(committed.columns))
