"""Keyword-stuffed, link-list and product-tag pages.

Method: a *suffix automaton* over each page's tokens.  Its states give every
maximal repeated substring with its number of occurrences, in time linear in
the page; the share of characters covered by substrings of at least two tokens
that occur ``MIN_TIMES`` times or more is the page's repetition.  Coverage is
combined with *missing clause structure*: a segment (sentence or line) is

* stuffed, if most of it is covered and it is no clause (no end mark, or a
  list of links, tags or separated keywords), or if one phrase recurs in at
  least ``PHRASE_RATE`` of all segments and takes a good part of it;
* honest, if it is a clause that is not stuffed;
* neutral otherwise (headings, quantities, references, glossary terms).

A page is a case if stuffed characters outweigh honest ones, page furniture
(:mod:`webloom.llm.boilerplate`) left out.  Work is per page and linear; the
only shuffles are those of page differencing.

Defined results: null, empty and blank bodies are no cases; very long texts
are read whole (memory is proportional to the page); repeated rows give
repeated answers; null titles count as empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.boilerplate import own_lines, own_pages
from webloom.llm.lines import CLOSERS, END_MARKS

MIN_TIMES = 3
PHRASE_RATE = 0.6
MIN_COVER = 0.6
MIN_STUFFED = 40

_DIGITS = re.compile("[0-9]+")
_TOKEN = re.compile(r"\x00|[^\W\d_぀-ヿ㐀-鿿฀-๿]+|[0-9]+|[぀-ヿ㐀-鿿]|[฀-๿]{1,4}|[#|]")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_SPACED_TOKEN = re.compile(r"[^\W\d_]+|[\x000#|]")
_ASCII_TOKEN = re.compile(r"[a-z]+|[\x000#|]")
#: A mark that ends a segment and what is dropped after it.
_BREAK = re.compile(r"[.!?…।؟][\"'”’»)\]]*\s+|[。！？](?:[\"'”’»)\]]*\s+)?")
_LINKS = re.compile(r"https?://|www\.|\.(?:com|net|org|example)\b|(?:^|[\s,;])#\w|\bSKU\b|[|;•]\s|_\w+_")
#: One of these stands in every text in which ``_LINKS`` finds something.
_LINK_SIGNS = ("://", "www.", ".com", ".net", ".org", ".example", "#", "SKU", "|", ";", "•", "_")
_THAI = re.compile(r"[\u0e00-\u0e7f]{12}")
_NEUTRAL = re.compile(r"^(?:[0-9]+(?:[.,/][0-9]+)? ?\w{1,3}\s|\[[0-9]+\]|[0-9]+[.)]\s|[-–—•*]\s)")


def repeated_cover(tokens: list[str]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Per token 1 if a repeated substring covers it; the repeated substrings as (times, length, last position).

    A substring of ``MIN_TIMES`` occurrences holds no pair of tokens of fewer, so
    the automaton is built over the runs of frequent pairs, kept apart by marks.
    """
    pairs = list(zip(tokens, tokens[1:]))
    times = Counter(pairs)
    kept: list[int] = []
    place: list[int] = []
    ids: dict[str, int] = {}
    i, total = 0, len(tokens)
    often = [times[p] >= MIN_TIMES for p in pairs]
    often.append(False)
    runs = sum(1 for x, y in zip([False, *often], often) if y and not x)
    for _ in range(runs):
        i = often.index(True, i)
        j = often.index(False, i) + 1
        kept.extend([ids.setdefault(t, len(ids)) for t in tokens[i:j]])
        kept.append(-1 - i)
        place.extend(range(i, j + 1))
        i = j
    cover = [0] * total
    if not kept:
        return cover, []
    flags, repeats = _automaton(kept)
    for at, c in zip(place, flags):
        if c:
            cover[at] = 1
    return cover, [(k, ln, place[e]) for k, ln, e in repeats]


def _automaton(tokens: list[int]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Cover flags and repeated substrings of the marked token sequence."""
    n = len(tokens)
    nxt: list[dict] = [{}]
    link, length, end, count = [-1], [0], [-1], [0]
    state_at, last = [], 0
    for i, t in enumerate(tokens):
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        end.append(i)
        count.append(1)
        p = last
        while p != -1 and t not in nxt[p]:
            nxt[p][t] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][t]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(length)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(end[q])
                count.append(0)
                while p != -1 and nxt[p].get(t) == q:
                    nxt[p][t] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
        state_at.append(cur)
    order = sorted(range(1, len(length)), key=length.__getitem__)
    for v in reversed(order):
        if link[v] > 0:
            count[link[v]] += count[v]
    longest = [0] * len(length)  # of the repeated suffixes of a state's substring
    for v in order:
        longest[v] = length[v] if count[v] >= MIN_TIMES else longest[link[v]]
    cover, left = [0] * n, n
    for i in range(n - 1, -1, -1):
        reach = longest[state_at[i]]
        if reach >= 2:
            left = min(left, i - reach + 1)
        if left <= i:
            cover[i] = 1
    return cover, [(count[v], length[v], end[v]) for v in order if count[v] >= MIN_TIMES and length[v] >= 2]


def _segments(lines: list[tuple[str, bool]]) -> tuple[list[str], list[str], list[int]]:
    """Segments of the own lines that are no bylines or headings, their tokens, and the bounds of each segment's tokens."""
    segments: list[str] = []
    for line, aside in lines:
        if aside:
            continue
        if len(line) > 60:
            at = 0
            for m in _BREAK.finditer(line):
                segments.append(line[at : m.start() + 1])
                at = m.end()
            segments.append(line[at:])
        else:
            segments.append(line)
    segments = [s for s in segments if s and not s.isspace()]
    text = _DIGITS.sub("0", "\x00".join(segments).lower())
    found = (_ASCII_TOKEN if text.isascii() else _TOKEN if _UNSPACED.search(text) else _SPACED_TOKEN).findall(text)
    tokens: list[str] = []
    bounds, at = [0], 0
    for _ in range(found.count("\x00")):
        end = found.index("\x00", at)
        tokens += found[at:end]
        bounds.append(len(tokens))
        at = end + 1
    tokens += found[at:]
    bounds.append(len(tokens))
    return segments, tokens, bounds


def _is_clause(s: str, n_tokens: int) -> bool:
    tail = s.rstrip().rstrip(CLOSERS)
    return bool(tail) and n_tokens >= 3 and (tail[-1] in END_MARKS or _THAI.search(s) is not None)  # Thai has no end marks


def page_stuffing(lines: list[tuple[str, bool]]) -> tuple[int, int]:
    """Stuffed and honest characters of a page, given by its own lines and whether they are bylines or headings."""
    return _weigh(*_segments(lines))


def page_is_spam(lines: list[tuple[str, bool]]) -> bool:
    """:func:`is_spam` of :func:`page_stuffing`.

    Where no phrase is frequent enough to be stuffing, a clause that cannot be
    a list of links is honest whatever repeats in it; if such clauses outweigh
    all the rest, the repeats need not be known.
    """
    segments, tokens, bounds = _segments(lines)
    if not _may_recur(tokens, _phrase_times(segments)):
        upto = [0, *accumulate(map(len, tokens))]
        linked = _may_link("\n".join(segments))
        doubtful = honest = 0
        for s, a, b in zip(segments, bounds, bounds[1:]):
            if _is_clause(s, b - a) and not (linked and _LINKS.search(s)):
                honest += upto[b] - upto[a]
            else:
                doubtful += upto[b] - upto[a]
        if not is_spam(doubtful, honest):
            return False
    return is_spam(*_weigh(segments, tokens, bounds))


def _phrase_times(segments: list[str]) -> float:
    return max(MIN_TIMES + 2, PHRASE_RATE * len(segments))


def _may_link(text: str) -> bool:
    for x in _LINK_SIGNS:
        if x in text:
            return True
    return False


def _may_recur(tokens: list[str], need: float) -> bool:
    """Whether two neighbouring tokens recur ``need`` times."""
    often = {t for t, n in Counter(tokens).items() if n >= need}
    return bool(often) and any(n >= need for n in Counter([p for p in zip(tokens, tokens[1:]) if p[0] in often and p[1] in often]).values())


def _weigh(segments: list[str], tokens: list[str], bounds: list[int]) -> tuple[int, int]:
    widths = list(map(len, tokens))
    cover, repeats = repeated_cover(tokens)
    upto = [0, *accumulate(widths)]
    covered_upto = [0, *accumulate(map(mul, widths, cover))]
    need = _phrase_times(segments)
    best = max(((times * (upto[e + 1] - upto[e - ln + 1]), ln, e) for times, ln, e in repeats if times >= need), default=None)
    phrase_upto = None
    if best:
        words = tokens[best[2] - best[1] + 1 : best[2] + 1]
        first, k, phrase = words[0], len(words), [0] * len(tokens)
        for i, t in enumerate(tokens):
            if t == first and tokens[i : i + k] == words:
                phrase[i : i + k] = [1] * k
        phrase_upto = [0, *accumulate(map(mul, widths, phrase))]
    stuffed = honest = 0
    for n, s in enumerate(segments):
        a, b = bounds[n], bounds[n + 1]
        size = upto[b] - upto[a]
        if not size:
            continue
        covered = (covered_upto[b] - covered_upto[a]) / size
        on_phrase = (phrase_upto[b] - phrase_upto[a]) / size if phrase_upto else 0.0
        clause = _is_clause(s, b - a)
        links = (not clause or covered > 0.3) and _LINKS.search(s) is not None
        clause = clause and not links
        if on_phrase >= 0.25 or (not clause and (links or (covered >= MIN_COVER and not _NEUTRAL.match(s)))):
            stuffed += size
        elif clause:
            honest += size
    return stuffed, honest


def is_spam(stuffed: int, honest: int) -> bool:
    return stuffed > honest and stuffed >= MIN_STUFFED


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("body", "gone", "aside")))
        sums = [page_stuffing(own_lines(*row)) for row in rows]
        arrays = [batch.column("seq"), pa.array([x for x, _ in sums], pa.int64()), pa.array([x for _, x in sums], pa.int64()), pa.array([is_spam(*x) for x in sums], pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, names=["seq", "stuffed", "honest", "is_spam"])


def score_pages(docs: DataFrame) -> DataFrame:
    """(seq, stuffed, honest, is_spam) of every page with text, in characters of its own lines."""
    return own_pages(docs, "body").select("seq", "body", "gone", "aside").mapInArrow(_score, "seq long, stuffed long, honest long, is_spam boolean")
