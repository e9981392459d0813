"""Main text of web pages by differencing each page against its nearest URLs.

Method: *nearest-URL page differencing*.  Pages are range-partitioned and
sorted by (host, url path), so a page stands next to the pages whose paths are
closest; each is aligned, line by line and by longest common subsequence, with
the ``NEIGHBOURS`` nearest pages of other urls before it.  Shared lines, marked
on both pages, are what the site prints around its content.

Lines are compared by *template* (see :mod:`webloom.llm.lines`), so that
"Sponsored: lamps by A" and "Sponsored: clocks by B" align.  How often a
template is shared, out of all its occurrences, is summed over the corpus: a
template on at least ``MIN_SHARED`` pages of such pairs, and shared with a page
before in ``MIN_RATE`` of its occurrences, is page furniture wherever it stands, also on a page whose own
neighbours happen not to show it.  Headings of link lists are those furniture
templates that are mostly followed by several title-like lines; the title-like
lines after such a heading go with it.

Scale: one range shuffle of the bodies (a hot host is split by url path, never
collected), then only 64-bit keys move.  State per task: the last
``NEIGHBOURS`` pages' keys, and the batches that hold these pages.

Defined results: null, empty and blank bodies have no lines; null hosts and
urls are ordinary (equal) values; exact copies and recrawls (same url) are not
compared with each other; rows of one ``seq`` are one page; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.lines import CLOSERS, END_MARKS, LONG_LINE, key64, squeeze, template
from webloom.session import materialize

NEIGHBOURS = 8
MIN_SHARED = 2
MIN_RATE = 0.05
#: Share of a heading's occurrences followed by two or more title-like lines.
MIN_LISTED = 0.4
#: Above this share of common lines, no line of prose being different, two pages are copies and prove nothing.
COPY_SHARE = 0.8
#: A line of at least this many characters is prose.
PROSE_CHARS = 60

TITLE, CAPS, BYLINE, SHARED, LISTED, OWN, PROSE, LATER = 1, 2, 4, 8, 16, 32, 64, 128  # LATER: shared with a page before

#: How bylines open, close or look (fixed values).
_BYLINE = re.compile(
    r"^(?:(?:by|posted by|written by|words:|text:|von|par|por|da|autor:?|автор:?) [^\W\d_]|作者[：:]|文[・：:]|ผู้เขียน|लेखक|بقلم)", re.I
)
_BYLINE_END = ", staff writer"
_NAME = r"[A-ZÀ-Þ][^\W\d_]{2,}"
_NAMES_ONLY = re.compile(rf"^{_NAME} {_NAME}(?:, (?:(?:à|en|em|in) )?{_NAME})?$")
_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[0-9]+")
_LIST_MARKS = "-–—•*·#>»«"
_CACHE_LINES = 50_000


def classify_line(s: str) -> tuple[int, int]:
    """Key and shape bits of one squeezed line; blank lines have key 0."""
    if not s:
        return 0, 0
    t, bits = template(s), PROSE if len(s) >= PROSE_CHARS else 0
    if len(s) > 3 and s.isupper():
        bits |= CAPS
    tail = s.rstrip(CLOSERS)
    wordy = len(s) <= LONG_LINE and s.count(" ") >= 3 or (8 <= len(s) <= LONG_LINE and not s.isascii() and s.count(" ") <= 1)
    if wordy and tail and tail[-1] not in END_MARKS and s[0] not in _LIST_MARKS and t[-1] not in ":>" and not _DIGIT.search(s):
        bits |= TITLE
    if _BYLINE.match(s) or s[-len(_BYLINE_END) :].lower() == _BYLINE_END or _NAMES_ONLY.match(s.title() if bits & CAPS else s):
        bits |= BYLINE
    return key64(t), bits


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (0 never matches)."""
    return _common(a, b, (set(a) & set(b)) - {0})


def _common(a: list[int], b: list[int], both: set[int]) -> list[int]:
    if not both:
        return []
    ia = [i for i, x in enumerate(a) if x in both]
    xa = [a[i] for i in ia]
    xb = [x for x in b if x in both]
    if xa == xb:
        return ia
    if len(both) == len(xa) == len(xb):  # no template twice: the longest ascending run of places
        place = {x: j for j, x in enumerate(xb)}
        return [ia[i] for i in _ascending([place[x] for x in xa])]
    n, m = len(xa), len(xb)
    rows = [[0] * (m + 1)]
    for x in xa:
        above, row = rows[-1], [0]
        for j, y in enumerate(xb):
            row.append(above[j] + 1 if x == y else max(row[j], above[j + 1]))
        rows.append(row)
    out, i, j = [], n, m
    while i and j:
        if xa[i - 1] == xb[j - 1]:
            i, j = i - 1, j - 1
            out.append(ia[i])
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _ascending(places: list[int]) -> list[int]:
    """Positions of a longest ascending subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, x in enumerate(places):
        k = bisect_left(tops, x)
        before.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[k], at[k] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


class _Held:
    """A batch whose pages may still be found to share lines with pages to come."""

    def __init__(self, seqs: pa.Array) -> None:
        self.seqs, self.pages = seqs, []  # type: pa.Array, list[tuple[list[int], list[int]]]

    def finish(self) -> pa.RecordBatch:
        for keys, bits in self.pages:
            titles = [bool(b & TITLE) and not b & (LATER | BYLINE | OWN) for b in bits]
            if sum(titles) < 2:
                continue
            filled = [i for i, k in enumerate(keys) if k]
            for i, j, k in zip(filled, filled[1:], filled[2:]):
                if titles[j] and titles[k]:
                    bits[i] |= LISTED
        arrays = [self.seqs, pa.array([p[0] for p in self.pages], pa.list_(pa.int64())), pa.array([p[1] for p in self.pages], pa.list_(pa.int16()))]
        return pa.RecordBatch.from_arrays(arrays, names=["seq", "keys", "bits"])


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    recent: list[tuple[str, list[int], int, set[int], set[int], list[int], _Held]] = []
    held: list[_Held] = []  # at most one for each recent page
    known: dict[str, tuple[int, int]] = {}
    as_usual: dict[str, int] = {}  # a line set in capitals takes the key of the same line set as usual

    def classify(line: str) -> tuple[int, int]:
        s = squeeze(line)
        kb = classify_line(s)
        if kb[1] & CAPS:
            return as_usual.get(_DIGITS.sub("0", s.lower()), kb[0]), kb[1]
        if len(line) <= LONG_LINE:
            if len(known) >= _CACHE_LINES:
                known.clear()
                as_usual.clear()
            known[line] = kb
            if kb[0]:
                as_usual[_DIGITS.sub("0", s.lower())] = kb[0]
        return kb

    for batch in batches:
        held.append(here := _Held(batch.column("seq")))
        for url, title, body in zip(*(batch.column(c).to_pylist() for c in ("url", "title", "body"))):
            lines, title = body.split("\n"), squeeze(title or "")
            found = [known.get(line) or classify(line) for line in lines]
            keys, bits = [k for k, _ in found], [b for _, b in found]
            if title:
                for i, b in enumerate(bits):
                    if b & TITLE and title.startswith(squeeze(lines[i])):
                        bits[i] |= OWN
            here.pages.append((keys, bits))
            filled = len(keys) - keys.count(0)
            mine = set(keys)
            mine.discard(0)
            prose = {k for k, b in found if b & PROSE}
            for other, theirs, n, known_theirs, their_prose, their_bits, _ in recent:
                if other == url or not (both := mine & known_theirs):
                    continue
                same = _common(keys, theirs, both)
                if len(same) == filled == n or (filled > 2 and len(same) >= COPY_SHARE * max(filled, n) and prose <= both and their_prose <= both):
                    continue
                at = 0
                for i in same:  # both pages of a pair show the line
                    bits[i] |= SHARED | LATER
                    at = theirs.index(keys[i], at)
                    their_bits[at] |= SHARED
                    at += 1
            recent = [r for r in recent if r[0] != url][-NEIGHBOURS + 1 :] + [(url, keys, filled, mine, prose, bits, here)]
        waiting = {id(r[6]) for r in recent}
        for h in held:
            if id(h) not in waiting:
                yield h.finish()
        held = [h for h in held if id(h) in waiting]
    for h in held:
        yield h.finish()


def page_order(docs: DataFrame) -> DataFrame:
    """Pages sorted so that the nearest urls of a host are neighbours."""
    host = F.rtrim(F.lower(F.coalesce("host", F.lit(""))), F.lit("."))
    path = F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-zA-Z]+://[^/]*", "")
    pages = docs.where(F.trim(F.coalesce("body", F.lit(""))) != "").select(
        "seq", F.coalesce("url", F.lit("")).alias("url"), "title", "body", host.alias("_host"), path.alias("_path")
    )
    return pages.repartitionByRange("_host", "_path", "seq").sortWithinPartitions("_host", "_path", "seq").select("seq", "url", "title", "body")


def difference_pages(docs: DataFrame) -> DataFrame:
    """(seq, keys, bits): key and shape/shared bits of each line of each page."""
    return page_order(docs).mapInArrow(_differ, "seq long, keys array<long>, bits array<smallint>")


def furniture_templates(lines: DataFrame) -> DataFrame:
    """(key, heading): templates whose sharing rate marks them as page furniture."""
    one = F.explode(F.arrays_zip("keys", "bits")).alias("x")
    is_ = lambda bit: F.sum((F.col("x.bits").bitwiseAND(bit) != 0).cast("int"))
    stats = (
        lines.select(one)
        .where("x.keys != 0")
        .groupBy(F.col("x.keys").alias("key"))
        .agg(F.count("*").alias("n"), is_(SHARED).alias("n_shared"), is_(LATER).alias("n_later"), is_(LISTED).alias("n_listed"), is_(BYLINE).alias("n_byline"))
    )
    return stats.where((F.col("n_shared") >= MIN_SHARED) & (F.col("n_later") >= MIN_RATE * F.col("n")) & (F.col("n_byline") == 0)).select(
        "key", ((F.col("n_listed") >= MIN_LISTED * F.col("n")) & (F.col("n_listed") >= 2)).alias("heading")
    )


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("rows")
        offsets = rows.offsets.to_numpy()
        page = np.repeat(np.arange(len(rows)), np.diff(offsets))
        numbers, keys, bits, kinds = (rows.values.field(name).to_numpy()[offsets[0] : offsets[-1]] for name in ("line_no", "keys", "bits", "kind"))
        place = page << 32 | numbers
        order = np.argsort(place, kind="stable")
        page, numbers, keys, bits, kinds = (x[order] for x in (page, numbers, keys, bits, kinds))
        if (np.diff(place[order]) == 0).any():  # rows of one seq are the same page
            order = np.lexsort((kinds, bits, keys, numbers, page))
            rest = [x[order] for x in (page, numbers, keys, bits, kinds)]
            new = np.ones(len(page), dtype=bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in rest])
            page, numbers, keys, bits, kinds = (x[new] for x in rest)
        listed = np.zeros(len(page), dtype=bool)
        marked = (kinds != 0) | ((bits & (CAPS | SHARED | BYLINE)) == (CAPS | SHARED))
        heads = page[kinds == 2]
        cuts = np.searchsorted(page, np.arange(len(rows) + 1))
        for i in np.unique(heads).tolist():
            a, b = cuts[i], cuts[i + 1]
            listed[a:b] = _gone(bits[a:b].tolist(), kinds[a:b].tolist())
        gone = marked | listed
        aside = ~gone & ((bits & (BYLINE | OWN)) != 0)
        own = ~gone & ~aside
        left = keys[own]
        ends = np.concatenate([[0], np.cumsum(own)])[cuts].tolist()
        skeletons = [_hash_keys(left[a:b]) for a, b in zip(ends, ends[1:])]
        rests = [_hash_keys(left[a + 1 : b]) for a, b in zip(ends, ends[1:])]
        arrays = [batch.column("seq")]
        for flags in (gone, aside):
            upto = np.concatenate([[0], np.cumsum(flags)])[cuts]
            arrays.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(numbers[flags], pa.int32())))
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(skeletons, pa.int64()), pa.array(rests, pa.int64())], names=["seq", "gone", "aside", "skeleton", "rest"])


def _hash_keys(keys: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(keys.tobytes()) - (1 << 63) or 1 if len(keys) else 0


def _gone(bits: list[int], kinds: list[int]) -> list[bool]:
    """Furniture flags of a page's lines: furniture templates (kind 1, headings of link lists 2) and the titles listed under a heading."""
    gone, run, last = [], False, len(bits) - 1
    for i, (b, kind) in enumerate(zip(bits, kinds)):
        if kind or (b & CAPS and b & SHARED and not b & BYLINE):
            gone.append(True)
            run = kind == 2
            continue
        run = run and bool(b & TITLE) and not b & (BYLINE | OWN) and not (i < last and bits[i + 1] & BYLINE)
        gone.append(run)
    return gone


def judge_lines(lines: DataFrame) -> DataFrame:
    """(seq, gone, aside, skeleton, rest) of each page with text, once for each seq.

    Numbers, from 1, of the lines that are furniture and of the bylines and
    headings among the others; hashes of the templates of all remaining lines
    in order, and of those but the first, 0 if there is none.  ``lines`` is read twice: pass a
    materialised result of :func:`difference_pages`.
    """
    each = lines.select("seq", F.posexplode(F.arrays_zip("keys", "bits")).alias("pos", "x")).where("x.keys != 0")
    each = each.select("seq", (F.col("pos") + 1).alias("line_no"), "x.*")
    kinds = furniture_templates(lines).select(F.col("key").alias("keys"), F.when(F.col("heading"), 2).otherwise(1).alias("kind"))
    row = F.struct("line_no", "keys", "bits", F.coalesce("kind", F.lit(0)).alias("kind"))
    marked = each.join(kinds, "keys", "left").select("seq", row.alias("r"))
    grouped = marked.groupBy("seq").agg(F.collect_list("r").alias("rows"))  # the lines of one page
    return grouped.mapInArrow(_mark, "seq long, gone array<int>, aside array<int>, skeleton long, rest long")


def judged_pages(docs: DataFrame) -> DataFrame:
    """:func:`difference_pages` and :func:`judge_lines` in one."""
    return judge_lines(materialize(difference_pages(docs), "lines"))


def own_pages(docs: DataFrame, *columns: str) -> DataFrame:
    """(seq, *columns, gone, aside, skeleton, rest) of every page with text; the bodies meet the line numbers by seq."""
    judged = judged_pages(docs).withColumnRenamed("seq", "_seq").hint("shuffle_hash")  # a few numbers a page; the bodies need no sort
    pages = docs.where(F.trim(F.coalesce("body", F.lit(""))) != "").select("seq", *columns)
    return pages.join(judged, F.col("seq") == F.col("_seq")).drop("_seq")


def int_lists(column: pa.ListArray) -> list[list[int]]:
    """A column of lists without nulls."""
    offsets, values = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
    values = values[offsets[0] : offsets[-1]].tolist()
    return [values[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets, offsets[1:])]


def own_lines(body: str, gone: list[int], aside: list[int]) -> list[tuple[str, bool]]:
    """The page's own non-blank lines and whether each is a byline or heading."""
    return parted_lines(body, gone, aside)[0]


def parted_lines(body: str, gone: list[int], aside: list[int]) -> tuple[list[tuple[str, bool]], list[str]]:
    """:func:`own_lines` and the page's furniture lines."""
    lines = body.split("\n")
    furniture = [lines[n - 1] for n in gone]
    for n in gone:
        lines[n - 1] = ""
    if aside:
        beside = set(aside)
        return [(line, n in beside) for n, line in enumerate(lines, 1) if line and not line.isspace()], furniture
    return [(line, False) for line in lines if line and not line.isspace()], furniture


def furniture(docs: DataFrame) -> DataFrame:
    """(seq, furniture): numbers, from 1, of the lines that hold nothing of the page's own; one row for each seq."""
    return judged_pages(docs).select("seq", F.col("gone").alias("furniture"))


def own_body(body: Column, numbers: Column) -> Column:
    """The body without the numbered lines."""
    kept = F.filter(F.split(body, "\n", -1), lambda _, i: ~F.array_contains(numbers, (i + 1).cast("int")))
    return F.array_join(kept, "\n")


def clean_pages(docs: DataFrame) -> DataFrame:
    """(seq, own_body, n_removed) for every page; a null body stays null."""
    gone = furniture(docs).select(F.col("seq").alias("_seq"), "furniture")
    numbers = F.coalesce("furniture", F.array().cast("array<int>"))
    return docs.join(gone, F.col("seq") == F.col("_seq"), "left").select(
        "seq", own_body(F.col("body"), numbers).alias("own_body"), F.size(numbers).cast("long").alias("n_removed")
    )
