"""Template residue, filler and error-page text.

Method: *template alignment with slots*.  Records of one template are aligned
and the places where they differ are its slots.

* A marker of a template language, or another filler that is no value (a
  variable name, ``N/A``, ruled blanks), is a candidate.  Its *window*, the up
  to ``SIDE`` words on either side within the sentence, names a place in a
  template; a second pass over all texts aligns the window with the records
  that carry nothing, a name or a number there.  A marker is an unfilled slot
  unless its window recurs on other pages and always holds a marker: such
  sentences are about markers.  The weaker candidates are unfilled slots only
  where ``MIN_VALUES`` different values stand in the other records.  A record
  that is no sentence (a title, a heading, a line of nothing else) has no
  words that could talk about a marker.
* A page whose own lines, line template by line template, recur as the whole
  text of pages on ``MIN_HOSTS`` or more hosts is an error, block, script or
  sample page; of a longer first sentence one half is enough, so that a name in
  the other does not hide the template.  The sentences of these pages are templates in turn: a page all
  of whose sentences align with them, with at most one word differing, is one
  too.
* A page all of whose lines are filler text (lorem ipsum) is a case.

Page furniture is left out by page differencing.  Only keys and counts move in
the shuffles, and bodies of the few pages that may align; the windows asked for
reach the second pass as a bitmap of fixed size, so no broadcast grows.

Defined results: null and blank titles and bodies are searched as empty; pages
without any text are no cases; rows of one seq are one page; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.boilerplate import own_lines, own_pages
from webloom.llm.lines import CLOSERS, END_MARKS, key64, squeeze
from webloom.session import materialize

MIN_HOSTS = 3
#: Words of a first sentence of which half is enough to know a page's template by.
MIN_WORDS = 8
#: Words of a window on either side of a slot.
SIDE = 3
#: Different values that prove a slot to records without a marker's syntax.
MIN_VALUES = 3
#: Least share of the filler words lorem/ipsum in a filler text.
FILLER_RATE = 0.015
#: Bits of the bitmap of asked windows; a fuller bitmap only lets more rows through.
WINDOW_BITS = 20

#: Up to so many words of asked windows, only lines that hold one of them are aligned.
MAX_WORDS = 500

#: Slot markers of common template languages (fixed values).
MARKER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%[=-]?[^%\n]{1,60}%>|\[%[^%\n]{1,60}%\]|%%[A-Za-z_]\w*%%|%\([a-z_]+\)s"
    r"|[$#]\{[A-Za-z_][\w.]*\}|\[\[[A-Za-z_][\w. ]*\]\]|\[INSERT [^\]\n]+\]|\[(?:YOUR|ENTER|ADD) [^\]\n]+\]"
    r"|@@\w+@@|__[A-Z][A-Z_]*__|<<[a-z_]\w*>>|&lt;[a-z_]\w*&gt;|(?<![\w$#{'\"])\{[a-z_][a-z_.]*\}(?!\})"
)
#: Other fillers that are no value: variable names, defaults and blanks (fixed values).
BLANK = re.compile(
    r"<[A-Za-z][\w -]{0,40}>|(?<!\w)\[[A-Za-z][A-Za-z _-]{1,40}\]|\{[0-9]\}|(?<!\w)_{3,}(?!\w)|(?<![\w/])[Nn]/[Aa](?![\w/])|\b(?:TBD|TBA|XXX+)\b"
    r"|(?<![A-Z] )\b(?!UPDATE)[A-Z]{2,}_?(?:NAME|TITLE|DATE|PRICE|TEXT|CITY|EMAIL|ADDRESS|NUMBER)\b(?! [A-Z]{2})|\b[a-z]+_(?:name|title|date|price|text|city|email|address|number|id)\b"
)
#: One of these stands in every text that holds a candidate.
_SIGNS = ("{", "<", "[", "%%", "%(", "@@", "__", "&lt;", "N/A", "n/a", "TBD", "TBA", "XXX", "_name", "_title", "_date", "_price", "_text", "_city", "_email", "_address", "_number", "_id")
_VARIABLES = ("NAME", "TITLE", "DATE", "PRICE", "TEXT", "CITY", "EMAIL", "ADDRESS", "NUMBER")
_ANY_SIGN = "|".join(map(re.escape, (*_SIGNS, *_VARIABLES)))
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]]*\s+|(?<=[。！？])")
#: The first end by ``_SENTENCE``, with its mark.
_FIRST_END = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？](?:[\"'”’»)\]]*\s+)?")
_FILLER = re.compile(r"\b(?:lorem|ipsum)\b", re.I)
_DIGIT = re.compile("[0-9]")
_PLAIN = re.compile(r"\b(?:the|and|of|in|is|der|die|und|le|les|et|los|que|para)\b", re.I)

_BREAK = "\x02"
_AROUND = "\"'“”‘’„«»‹›()[]{}「」『』（）,;:،؛，、；：.!?…。！？؟।॥—–-"
_STOP, _NAMED, _NUMBER, _CANDIDATE, _EMPTY, _END, _DIGIT_IN = (1 << k for k in range(32, 39))
_CRC = (1 << 32) - 1
#: The sign that names and numbers count as.
_SIGN = 1


class _Tokens(dict):
    """Token -> crc of its bare lower-case word, and what it is: end of a sentence, name, number, candidate, line break."""

    def __missing__(self, t: str) -> int:
        if len(self) > 200_000:
            self.clear()
        if t.isalpha():
            code = crc32(t.lower().encode()) | (_NAMED if t[0].isupper() else 0)
        elif t in "\x00\x01":
            code = _CANDIDATE
        elif t == _BREAK:
            code = _STOP | _END
        else:
            bare, tail = t.strip(_AROUND), t.rstrip(CLOSERS)
            code = crc32(bare.lower().encode()) if bare else _EMPTY
            if tail and tail[-1] in END_MARKS:
                code |= _STOP
            if _DIGIT.search(t):
                code |= _DIGIT_IN
            if bare and (bare[0].isdigit() or bare[-1].isdigit()):
                code |= _NUMBER
            elif bare and bare[0].isupper():
                code |= _NAMED
        self[t] = code
        return code


_codes = _Tokens()
#: Characters aligned in one go.
_CHUNK = 500_000
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def _has_sign(text: str) -> bool:
    for x in _SIGNS:
        if x in text:
            return True
    for x in _VARIABLES:
        if x in text:
            return True
    return False


def opened(text: str) -> str:
    """The text with every candidate replaced by a control character."""
    return "\n".join([BLANK.sub(" \x01 ", MARKER.sub(" \x00 ", x)) if _has_sign(x) else x for x in text.split("\n")])


class Places:
    """The words of a text, its candidates replaced by :func:`opened`, and the gaps, numbered by the word that follows, in which these stood."""

    def __init__(self, text: str) -> None:
        toks = text.replace("\n", f" {_BREAK} ").split()
        kinds = np.fromiter(map(_codes.__getitem__, toks), dtype=np.int64, count=len(toks))
        odd = (kinds & (_CANDIDATE | _EMPTY)) != 0
        stop = (kinds & _STOP) != 0
        if odd.any():
            keep = ~odd
            at = np.cumsum(keep)  # kept words up to each token
            ends = at[odd & stop] - 1  # a mark that stands alone ends the word before
            self.candidates = [(int(at[i]), toks[i] == "\x00") for i in np.flatnonzero(kinds & _CANDIDATE)]
            self.toks = list(compress(toks, keep.tolist()))
            kinds, stop = kinds[keep], stop[keep]
            stop[ends[ends >= 0]] = True
        else:
            self.candidates, self.toks = [], toks
        self.stop, self.end = stop, (kinds & _END) != 0
        begins = np.concatenate([[True], stop[:-1]]) if len(stop) else stop
        self.value = ((kinds & _NUMBER) != 0) | (((kinds & _NAMED) != 0) & ~begins)
        self.named = (kinds & (_NUMBER | _NAMED)) != 0
        code = np.where(self.value, _SIGN, kinds & _CRC)
        code[self.end] = 0
        self.left, self.right = self._sides(code)

    def _sides(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per gap the mixed codes of the up to SIDE words before and after it within the sentence."""
        n = len(code)
        left, right = np.zeros(n + 1, dtype=np.uint64), np.zeros(n + 1, dtype=np.uint64)
        go_left, go_right = np.ones(n + 1, dtype=bool), np.ones(n + 1, dtype=bool)
        code = code.astype(np.uint64)
        for k in range(min(SIDE, n)):
            go_left[: k + 1] = False
            go_left[k + 1 :] &= ~self.stop[: n - k]
            left[k + 1 :] += np.where(go_left[k + 1 :], code[: n - k] * _FACTORS[k], np.uint64(0))
            go_right[n - k :] = False
            right[: n - k] += np.where(go_right[: n - k], code[k:] * _FACTORS[SIDE + k], np.uint64(0))
            go_right[: n - k] &= ~self.stop[k:]
        return left, right

    def closed(self, gap: int) -> bool:
        """The line goes on to an end mark."""
        while gap < len(self.toks) and not self.end[gap]:
            if self.stop[gap]:
                return True
            gap += 1
        return False

    def word(self, gap: int) -> str:
        """The longest word beside the gap that every record of its window holds, in lower case; '' if there is none to look for."""
        found = []
        for i in range(gap - 1, max(-1, gap - 1 - SIDE), -1):
            if self.stop[i]:
                break
            found.append(i)
        for i in range(gap, min(len(self.toks), gap + SIDE)):
            found.append(i)
            if self.stop[i]:
                break
        words = [self.toks[i].strip(_AROUND).lower() for i in found if not self.value[i] and not self.end[i]]
        return max((w for w in words if "\u0307" not in w), key=len, default="")  # the dot of a capital I that no pattern would find

    def key(self, gap: int) -> int:
        return int(np.int64(self.left[gap] ^ self.right[gap]))


def slots(text: str) -> tuple[bool, list[tuple[int, bool]]]:
    """Whether a marker stands where nothing can talk about it; the windows (key, is a marker) of all other candidates."""
    sure, windows = worded_slots(text)
    return sure, [(key, marker) for key, marker, _ in windows]


def worded_slots(text: str) -> tuple[bool, list[tuple[int, bool, str]]]:
    """:func:`slots` with the word of each window by which its records are looked for."""
    lines = [x for x in text.split("\n") if _has_sign(x)]
    if not lines:
        return False, []
    places = Places(opened("\n".join(lines)))
    sure, out = False, []
    for gap, marker in places.candidates:
        key = places.key(gap)
        if marker and not (key and places.closed(gap)):
            sure = True
        elif key:
            out.append((key, marker, places.word(gap)))
    return sure, out


def aligned(text: str, windows: np.ndarray) -> Iterator[tuple[int, int]]:
    """(window key, filler) of the places in the opened text that may be asked for: filler 0 is nothing, else the hash of a value."""
    p = Places(text)
    n = len(p.toks)
    free = np.ones(n + 1, dtype=bool)  # next to a candidate there is no record without one
    free[[gap for gap, _ in p.candidates]] = False

    def asked(gaps: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int]]:
        slot = (keys & np.uint64((1 << WINDOW_BITS) - 1)).astype(np.int64)
        hit = ((windows[slot >> 3] >> (slot & 7)) & 1).astype(bool) & (keys != 0)
        return zip(gaps[hit].tolist(), keys[hit].astype(np.int64).tolist())

    gaps = np.flatnonzero(free)
    for _, key in asked(gaps, p.left[gaps] ^ p.right[gaps]):
        yield key, 0
    right = np.append(p.right, np.uint64(0))
    for width in (1, 2):  # values of one or two words
        gaps = np.flatnonzero(p.named & free[:-1])
        gaps = gaps[gaps + width <= n]
        if width == 2:
            gaps = gaps[p.named[gaps + 1] & ~p.stop[gaps]]
        gaps = gaps[free[gaps + width]]
        after = np.where(p.stop[gaps + width - 1], np.uint64(0), right[gaps + width])
        for gap, key in asked(gaps, p.left[gaps] ^ after):
            yield key, key64(" ".join(p.toks[gap : gap + width]))


class _Plain(dict):
    """Token -> its bare lower-case word; '' if it has none, holds digits or is a name."""

    def __missing__(self, t: str) -> str:
        if len(self) > 200_000:
            self.clear()
        word = self[t] = "" if _codes[t] & (_EMPTY | _DIGIT_IN | _NAMED) else t.strip(_AROUND).lower()
        return word


_plain = _Plain()


def skeleton_words(sentence: str) -> list[str]:
    """Words of a message in lower case, without names and anything that holds digits."""
    toks = sentence.split()
    for i, t in enumerate(toks):
        if not _codes[t] & (_EMPTY | _DIGIT_IN):  # the first word may look like a name
            return [t.strip(_AROUND).lower(), *filter(None, map(_plain.__getitem__, toks[i + 1 :]))]
    return []


def message_sentences(lines: list[tuple[str, bool]]) -> list[list[str]]:
    """Words of each sentence of the page's own lines, bylines and headings left out."""
    found = [skeleton_words(s) for line, aside in lines if not aside for s in _SENTENCE.split(line) if s and not s.isspace()]
    return [w for w in found if w]


def is_filler(lines: list[tuple[str, bool]]) -> bool:
    """True if every own line is filler text: some with the two best-known words, the others without any plain word."""
    own = [line for line, aside in lines if not aside]
    if not any("orem" in x or "psum" in x for x in own):
        return False
    known = False
    for line in own:
        words, hits = line.count(" ") + 1, len(_FILLER.findall(line))
        if hits and hits >= FILLER_RATE * words and len(_PLAIN.findall(line)) <= 0.03 * words:
            known = True
        elif not (line.isascii() and words >= 4 and not _PLAIN.search(line) and not _DIGIT.search(line)):
            return False
    return known


#: Columns of :func:`page_facts`.
FACTS = "struct<sure:boolean, windows:array<struct<key:long, marker:boolean, word:string>>, filler:boolean, heads:array<long>, halves:array<long>>"


def page_facts(title: str, lines: list[tuple[str, bool]], signed: bool = True) -> dict:
    """``signed``: a sign of a candidate may stand in the body.  What the judgement of one page needs: certain slots, windows, filler, keys of its first sentence and of halves of its first line."""
    sure, windows = worded_slots(title) if title else (False, [])
    in_body, more = worded_slots("\n".join([x for x, _ in lines])) if signed else (False, [])
    line = next((x for x, aside in lines if not aside), "")
    end = _FIRST_END.search(line)
    first = skeleton_words(line[: end.start() + 1] if end else line)
    others = " ".join(skeleton_words(line[end.end() :])) if end else ""
    halves = [key64(f"{' '.join(first)} {others}")] if first or others else []
    heads = sentence_keys(first)
    if len(first) >= MIN_WORDS:
        halves += [key64(f"{k} {others}") for k in heads]
    return {
        "sure": sure or in_body,
        "windows": [{"key": k, "marker": m, "word": w} for (k, m), w in {(k, m): w for k, m, w in (*windows, *more)}.items()],
        "filler": is_filler(lines),
        "heads": heads,
        "halves": halves,
    }


def sentence_keys(words: list[str]) -> list[int]:
    """Two keys of which two sentences that differ in one word share at least one."""
    half = (len(words) + 1) // 2
    return [key64("<" + " ".join(words[: max(1, half - 1)])), key64(">" + " ".join(words[half:] or words))] if words else []


def signed(batch: pa.RecordBatch, column: str = "body") -> list[bool]:
    """Whether a sign of a candidate stands in each body."""
    return pc.match_substring_regex(batch.column(column), _ANY_SIGN).to_pylist()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("sure", pa.bool_()), ("windows", pa.list_(pa.struct([("key", pa.int64()), ("marker", pa.bool_()), ("word", pa.string())]))), ("filler", pa.bool_()), ("heads", pa.list_(pa.int64())), ("halves", pa.list_(pa.int64()))])
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("title", "body", "gone", "aside")), signed(batch))
        facts = [page_facts(squeeze(title or ""), own_lines(body, gone, aside), s) for title, body, gone, aside, s in rows]
        kept = ["seq", "host", "gone", "aside", "skeleton", "rest"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(facts, kind)], names=[*kept, "facts"])


def _bitmap(keys: DataFrame, bits: int) -> bytes:
    """Bitmap, of fixed size, of the lowest ``bits`` bits of column key."""
    slot = F.col("key").bitwiseAND((1 << bits) - 1)
    rows = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(s & 7 as int))")).alias("b")).collect()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in rows:  # at most 2 ** (bits - 3) rows
        out[r["at"]] = r["b"]
    return out.tobytes()


def _lines_with(words: list[str]) -> str | None:
    """Pattern of the lines that may hold a record of windows with these words; None if any line may."""
    return None if len(words) > MAX_WORDS or "" in words else "|".join(map(re.escape, sorted(words)))


def aligned_places(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, n_values, n_empty): what the records of all texts hold at the asked windows (key, word).

    If the windows have few words, only lines that hold one of them are aligned.
    """
    some = _lines_with([r["word"] for r in windows.select("word").distinct().limit(MAX_WORDS + 1).collect()])
    windows = windows.select("key").distinct()
    asked = docs.sparkSession.sparkContext.broadcast(_bitmap(windows, WINDOW_BITS))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.frombuffer(asked.value, dtype=np.uint8)
        for batch in batches:
            columns = [batch.column(c).cast(pa.string()) for c in ("title", "body")]
            lines = pa.chunked_array([pc.list_flatten(pc.split_pattern(x, "\n")) for x in columns]).unique()  # no window reaches across a line break
            if some is not None:
                lines = lines.filter(pc.match_substring_regex(lines, some, ignore_case=True))
            signed = pc.match_substring_regex(lines, _ANY_SIGN).to_pylist()
            texts = [opened(x) if s else x for x, s in zip(lines.to_pylist(), signed) if x]
            found: set[tuple[int, int]] = set()
            at = 0
            while at < len(texts):
                end = size = 0
                for end in range(at + 1, len(texts) + 1):
                    size += len(texts[end - 1])
                    if size > _CHUNK:
                        break
                found.update(aligned("\n".join(texts[at:end]), keys))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["key", "value"])

    places = docs.select("title", "body").mapInArrow(find, "key long, value long").distinct()
    return places.join(windows, "key", "left_semi").groupBy("key").agg(
        F.sum((F.col("value") != 0).cast("int")).alias("n_values"), F.max((F.col("value") == 0).cast("int")).alias("n_empty")
    )


def open_slots(docs: DataFrame, facts: DataFrame, asked_for: Column) -> DataFrame:
    """(seq) of the pages with an unfilled slot, from (seq, facts), among the pages ``asked_for``."""
    each = facts.select("seq", asked_for.alias("_asked"), F.explode("facts.windows").alias("w")).select("seq", "_asked", "w.*")
    often = each.groupBy("key").agg(F.count_distinct("seq").alias("n"))
    unsure = materialize(each.where("_asked").drop("_asked").join(often, "key"), "windows")
    asked = unsure.where(~F.col("marker") | (F.col("n") > 1))
    seen = aligned_places(docs, asked.select("key", "word"))
    judged = unsure.join(seen, "key", "left").na.fill(0, ["n_values", "n_empty"])
    marker = F.col("marker") & ((F.col("n") == 1) | (F.col("n_values") + F.col("n_empty") > 0))
    return facts.where(asked_for & F.col("facts.sure")).select("seq").unionByName(judged.where(marker | (~F.col("marker") & (F.col("n_values") >= MIN_VALUES))).select("seq")).distinct()


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for seq, body, gone, aside in zip(*(batch.column(c).to_pylist() for c in ("seq", "body", "gone", "aside"))):
            found = message_sentences(own_lines(body, gone, aside))
            for i, words in enumerate(found):
                for c, v in zip(cols, (seq, i, len(found), words, sentence_keys(words))):
                    c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["seq", "i", "n", "words", "heads"])


def repeated_pages(docs: DataFrame, facts: DataFrame, asked_for: Column) -> DataFrame:
    """(seq) of the pages ``asked_for`` whose whole text is a template of ``MIN_HOSTS`` hosts of any pages, or aligns with the sentences of such."""
    whole = facts.withColumn("_asked", asked_for).where("skeleton != 0 and not facts.sure and not facts.filler")
    # the whole text, and the text with one half of its first sentence left open
    variants = F.explode(F.concat(F.array("skeleton"), F.transform("facts.halves", lambda h: F.xxhash64(h, "rest")))).alias("variant")
    each = whole.select("seq", "_asked", F.xxhash64(F.rtrim(F.lower(F.coalesce("host", F.lit(""))), F.lit("."))).alias("host"), variants)
    on_hosts = each.groupBy("variant", "host").agg(F.min("seq").alias("seq"))
    templates = on_hosts.groupBy("variant").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).where(F.col("n") >= MIN_HOSTS)
    templates = materialize(templates.select("variant", "seq"), "page-templates")
    repeated = materialize(each.where("_asked").join(templates.select("variant"), "variant", "left_semi").select("seq").distinct(), "repeated-pages")
    whole = whole.select("seq", "_asked", "gone", "aside", "facts.heads")
    bodies = docs.where("body is not null").select("seq", "body")

    def sentences(pages: DataFrame) -> DataFrame:
        few = materialize(pages.select("seq", "gone", "aside"), "message-numbers")  # if so few that they are broadcast, the bodies stay where they are
        read = bodies.join(few, "seq").dropDuplicates(["seq"])
        return read.select("seq", "body", "gone", "aside").mapInArrow(_sentences, "seq long, i int, n int, words array<string>, heads array<long>")

    known = sentences(whole.join(templates.select("seq"), "seq", "left_semi")).dropDuplicates(["words"]).select(F.explode("heads").alias("head"), F.col("words").alias("known"))
    known = materialize(known, "message-templates")
    rest = whole.where("_asked").join(repeated, "seq", "left_anti")
    near = rest.select("seq", F.explode("heads").alias("head")).join(known.select("head").distinct(), "head", "left_semi").select("seq").distinct()
    tried = materialize(sentences(rest.join(near, "seq", "left_semi")), "message-pages")
    pairs = tried.select("seq", "i", "words", F.explode("heads").alias("head")).join(known, "head")
    differ = F.aggregate(F.zip_with("words", "known", lambda a, b: (~a.eqNullSafe(b)).cast("int")), F.lit(0), lambda x, y: x + y)
    fits = (F.size("words").between(F.size("known"), F.size("known") + 1)) & (differ <= F.when(F.size("words") > F.greatest(F.lit(2), F.size("known")), 1).when(F.size("words") > 2, 1).otherwise(F.size("words") - F.size("known")))
    met = pairs.where(fits).select("seq", "i").distinct().groupBy("seq").agg(F.count("*").alias("met"))
    aligned_too = tried.select("seq", "n").distinct().join(met, "seq").where("met = n").select("seq")
    return repeated.unionByName(aligned_too)


def judge(docs: DataFrame, facts: DataFrame, asked_for: Column | None = None) -> DataFrame:
    """(seq, kind), once for each page found, from materialised (seq, host, gone, aside, skeleton, rest, facts) of the pages with text.

    With ``asked_for``, a condition on ``facts``, only the pages that meet it
    are judged, by the windows and templates of all pages.
    """
    some = F.lit(True) if asked_for is None else asked_for
    found = open_slots(docs, facts, some).withColumn("kind", F.lit("open slot"))
    found = found.unionByName(facts.where(some & F.col("facts.filler")).select("seq", F.lit("filler").alias("kind")))
    found = found.unionByName(repeated_pages(docs, facts, some).withColumn("kind", F.lit("repeated page")))
    if asked_for is None:
        found = found.unionByName(_untexted(docs))
    return found.groupBy("seq").agg(F.min("kind").alias("kind"))


def _untexted(docs: DataFrame) -> DataFrame:
    """(seq, kind) of the pages that have nothing but a title with an open slot."""
    untexted = docs.where(F.length(F.trim(F.coalesce("body", F.lit("")))) == 0).where(F.col("title").rlike(r"[{\[%<@_#&]")).select("seq", "title")
    return untexted.mapInArrow(_title_only, "seq long, kind string")


def find_residue(docs: DataFrame) -> DataFrame:
    """(seq, kind): pages with an unfilled slot, or with nothing but messages or filler."""
    pages = own_pages(docs, "host", "title", "body")
    facts = pages.mapInArrow(_facts, f"seq long, host string, gone array<int>, aside array<int>, skeleton long, rest long, facts {FACTS}")
    return judge(docs, materialize(facts, "residue"))


def _title_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [s for s, t in zip(batch.column("seq").to_pylist(), batch.column("title").to_pylist()) if t and slots(squeeze(t))[0]]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(["open slot"] * len(rows), pa.string())], names=["seq", "kind"])
