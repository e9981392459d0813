"""Lines and passages repeated across one site's documents.

Method: *content-defined chunking*.  A rolling hash over ``WINDOW`` bytes of
the normalised text cuts it wherever ``CUT_MASK`` bits of the hash are zero;
line breaks are cuts too, and no cut lies within ``WINDOW`` bytes after one, so
a line is always cut into the same chunks whatever surrounds it, and text that
lost its breaks is still cut at the same places.  The distinct documents of
each (host, chunk) are counted; a chunk on at least ``MIN_URLS`` documents and
``MIN_SHARE`` of the host's urls is repeated excessively.

``repeated_lines`` takes each line's longest chunk as its anchor.  A line can
only be repeated if its anchor is, so the anchors give the candidates and an
exact count of distinct urls per (host, line) follows.  ``cut_repeated`` cuts
every repeated chunk out of the bodies.

Scale: only 64-bit hashes are shuffled, counts are partial aggregates, and a
hot host is spread over its chunks; nothing is collected per host.

Normalisation: lower case, white space runs (``\\r`` too) to one blank, trimmed,
digit runs to ``0``.  Defined results: null, empty and blank bodies have no
lines; null hosts form one host; null urls count as one url; repeated rows are
repeated in the answer; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import materialize

WINDOW = 12
CUT_MASK = 0x3F
MIN_URLS = 5
MIN_SHARE = 0.05

_DIGITS = re.compile("[0-9]+")
_GEAR = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([i]), seed=1) for i in range(256)), dtype="<u8").astype(np.uint64)
_CUT = 1 << 63


def normalise(line: str) -> str:
    return _DIGITS.sub("0", " ".join(line.lower().split()))


def _spans(line: str) -> tuple[str, list[int]]:
    """The normalised line, and for each of its characters the end in ``line`` of what it stands for."""
    chars: list[str] = []
    ends: list[int] = []
    for i, ch in enumerate(line, 1):
        if ch.isspace():
            if not chars:
                continue
            if chars[-1] == " ":
                ends[-1] = i
                continue
            low = " "
        elif ch in "0123456789":
            if chars and chars[-1] == "0" and ends[-1] == i - 1 and line[i - 2] in "0123456789":
                ends[-1] = i
                continue
            low = "0"
        else:
            low = ch.lower()
        chars.extend(low)
        ends.extend([i] * len(low))
    if chars and chars[-1] == " ":
        chars.pop()
        ends.pop()
    return "".join(chars), ends


def cut_line(line: str, pieces: list[bytes], hit: list[bool]) -> str:
    """The line without the pieces that are hit; what stays keeps its spelling."""
    text, ends = _spans(line)
    if text.encode() != b"".join(pieces).rstrip(b"\n"):  # lower-casing in context, as of a final sigma: cut by length then
        text, ends = line, list(range(1, len(line) + 1))
    kept, at, begin = [], 0, 0
    for piece, out in zip(pieces, hit):
        at = min(at + len(piece.decode(errors="ignore").rstrip("\n")), len(ends))
        end = ends[at - 1] if at else begin
        if not out:
            kept.append(line[begin:end])
        begin = end
    return "".join(kept).strip()


def chunk_ends(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks in the lines joined by breaks, and the line number of each end."""
    data = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
    gear = _GEAR[data]
    rolled = np.zeros(len(data), dtype=np.uint64)
    for k in range(min(WINDOW, len(data))):  # gear hash of the last WINDOW bytes
        rolled[k:] += gear[: len(gear) - k] << np.uint64(k)
    breaks = np.flatnonzero(data == 10)
    line_of = np.zeros(len(data), dtype=np.int64)
    line_of[breaks[:-1] + 1] = 1
    line_of = np.cumsum(line_of)
    starts = np.concatenate(([0], breaks[:-1] + 1))
    inside = np.arange(len(data)) - starts[line_of]
    cut = ((rolled >> np.uint64(20)) & np.uint64(CUT_MASK) == 0) & (inside >= WINDOW) & (data < 128)
    cut[breaks] = True
    ends = np.flatnonzero(cut)
    return ends, line_of[ends]


def chunks_of(lines: list[str]) -> list[list[bytes]]:
    """The chunks of each normalised line."""
    raw = [x.encode() for x in lines]
    ends, owner = chunk_ends(raw)
    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])))
    out: list[list[bytes]] = [[] for _ in raw]
    at = 0
    for e, i in zip(ends.tolist(), owner.tolist()):
        base = int(starts[i])
        piece = raw[i][max(at, base) - base : e + 1 - base]
        at = e + 1
        if piece:
            out[i].append(piece)
    return out


def _hash(b: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(b, seed) - _CUT


def _split(all_chunks: bool):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            uniques: list[str] = []
            pages = []
            for body in batch.column("body").to_pylist():
                page = []
                for line in body.split("\n"):
                    if (i := known.get(line)) is None:
                        i = known[line] = len(uniques)
                        uniques.append(normalise(line))
                    page.append(i)
                pages.append(page)
            pieces = chunks_of(uniques) if uniques else []
            keys = [_hash(x.encode()) if x else 0 for x in uniques]
            anchors: list[list[int]] = []
            for p in pieces:
                picked = p if all_chunks else [max(p, key=lambda b: (len(b), b))] if p else []
                anchors.append([_hash(b, 7) for b in picked])
            numbers, lines, chunks = [], [], []
            for page in pages:
                rows = [(n, keys[i], anchors[i]) for n, i in enumerate(page, 1) if anchors[i]]
                numbers.append([r[0] for r in rows])
                lines.append([r[1] for r in rows])
                chunks.append(sorted({c for r in rows for c in r[2]}) if all_chunks else [r[2][0] for r in rows])
            arrays = [batch.column(c) for c in ("seq", "host_id", "url_id")]
            arrays += [pa.array(numbers, pa.list_(pa.int32())), pa.array(lines, pa.list_(pa.int64())), pa.array(chunks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["seq", "host_id", "url_id", "line_no", "lines", "chunks"])

    return split


def chunk_pages(docs: DataFrame, all_chunks: bool) -> DataFrame:
    """(seq, host_id, url_id, line_no, lines, chunks) of every page with text.

    ``chunks`` holds each line's anchor, or with ``all_chunks`` the page's distinct chunks.
    """
    pages = docs.where(F.length(F.trim(F.coalesce("body", F.lit("")))) > 0).select(
        "seq", F.xxhash64(F.coalesce("host", F.lit(""))).alias("host_id"), F.xxhash64(F.coalesce("url", F.lit(""))).alias("url_id"), "body"
    )
    schema = "seq long, host_id long, url_id long, line_no array<int>, lines array<long>, chunks array<long>"
    return pages.mapInArrow(_split(all_chunks), schema)


def needed_urls(docs: DataFrame) -> DataFrame:
    """(host_id, need): distinct urls a text must stand on to be repeated excessively on its host."""
    ids = docs.select(F.xxhash64(F.coalesce("host", F.lit(""))).alias("host_id"), F.xxhash64(F.coalesce("url", F.lit(""))).alias("url_id"))
    counted = ids.distinct().groupBy("host_id").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= MIN_URLS).select("host_id", F.greatest(F.lit(float(MIN_URLS)), F.col("n") * F.lit(MIN_SHARE)).alias("need"))


def repeated_chunks(pages: DataFrame, need: DataFrame) -> DataFrame:
    """(host_id, chunk) of the chunks in at least ``need`` rows: candidates, as recrawls repeat an url."""
    one = pages.select("host_id", F.explode(F.array_distinct("chunks")).alias("chunk"))
    counted = one.groupBy("host_id", "chunk").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_URLS)
    return counted.join(need, "host_id").where(F.col("n") >= F.col("need")).select("host_id", "chunk")


def on_needed_urls(rows: DataFrame, key: str, need: DataFrame) -> DataFrame:
    """(host_id, key) of the texts on at least ``need`` distinct urls."""
    counted = rows.select("host_id", key, "url_id").distinct().groupBy("host_id", key).agg(F.count("*").alias("n"))
    return counted.join(need, "host_id").where(F.col("n") >= F.col("need")).select("host_id", key)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(seq, line_no): every occurrence of a line repeated excessively within its host."""
    pages, need = materialize(chunk_pages(docs, False), "chunks"), needed_urls(docs)
    rows = pages.select("seq", "host_id", "url_id", F.explode(F.arrays_zip("line_no", "lines", "chunks")).alias("x"))
    rows = rows.select("seq", "host_id", "url_id", F.col("x.line_no").cast("long").alias("line_no"), F.col("x.lines").alias("line"), F.col("x.chunks").alias("chunk"))
    candidates = rows.join(repeated_chunks(pages, need), ["host_id", "chunk"], "left_semi").drop("chunk")
    return candidates.join(on_needed_urls(candidates, "line", need), ["host_id", "line"], "left_semi").select("seq", "line_no")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies, removed = [], []
        for body, gone in zip(batch.column("body").to_pylist(), batch.column("gone").to_pylist()):
            if body is None or not gone:
                bodies.append(body)
                removed.append(0)
                continue
            bad, kept, n = set(gone), [], 0
            lines = body.split("\n")
            for line, pieces in zip(lines, chunks_of([normalise(x) for x in lines])):
                hit = [_hash(p, 7) in bad for p in pieces]
                n += sum(hit)
                if not pieces or not any(hit):
                    kept.append(line)
                elif not all(hit):
                    kept.append(cut_line(line, pieces, hit))
            bodies.append("\n".join(kept))
            removed.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("seq"), pa.array(bodies, pa.string()), pa.array(removed, pa.int64())], names=["seq", "clean_body", "n_cut"]
        )


def cut_repeated(docs: DataFrame) -> DataFrame:
    """(seq, clean_body, n_cut): bodies without repeated chunks.

    Chunks are found in the normalised lines and cut by their place in the
    lines as they are, so what stays keeps its spelling.
    """
    pages, need = materialize(chunk_pages(docs, True), "all-chunks"), needed_urls(docs)
    rows = pages.select("seq", "host_id", "url_id", F.explode("chunks").alias("chunk"))
    candidates = rows.join(repeated_chunks(pages, need), ["host_id", "chunk"], "left_semi")
    repeated = candidates.join(on_needed_urls(candidates, "chunk", need), ["host_id", "chunk"], "left_semi")
    gone = repeated.groupBy("seq").agg(F.collect_set("chunk").alias("gone"))
    return docs.select("seq", "body").join(gone, "seq", "left").mapInArrow(_cut, "seq long, clean_body string, n_cut long")
