"""Line keys shared by the training-data operators.

A *template* is a line in which everything that varies from page to page has
been masked: white space is collapsed, digit runs become ``0`` and capitalised
words after the first become ``#``.  A short lead-in before a separator
(``Next: ...``, ``Home > ...``) stands for the whole line.
"""

from __future__ import annotations

import re

import xxhash

#: Marks that may end a sentence, in any of the covered scripts.
END_MARKS = ".!?…。！？｡؟۔।॥"
#: Marks that may follow an end mark inside the same sentence.
CLOSERS = "\"'”’»›)]}」』）】》“"
#: A longer line is a paragraph: neither a title nor known by its lead-in.
LONG_LINE = 200

_DIGIT = re.compile("[0-9@]")
_DIGITS = re.compile(r"@\w+|\b[^\W\d_]*+[0-9][^\W_]*")
_INNER_CAP = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ](?<!^.)(?<![^\W\d_'’].)[^\W\d_]*(?:[-'’][^\W\d_]+)*")
_LATIN = re.compile(r"[A-Za-z]+")
_LEAD = re.compile(r"^((?:[^\W\d_]+[ '’]){0,2}[^\W\d_]+)\s?(?:([:：])(?!//)|[>›»/] )\s*\S")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_NAMES = re.compile(r"#(?:[ ,]*#)+")
_CUT = 1 << 63


def squeeze(line: str) -> str:
    """White space runs (``\\r`` too) reduced to one blank, ends trimmed."""
    return " ".join(line.split())


def template(s: str) -> str:
    """The squeezed line ``s`` with its variable parts masked."""
    if s[0] in "»›→" and 2 < len(s) <= LONG_LINE:
        return s[0]
    m = _LEAD.match(s) if len(s) <= LONG_LINE else None
    if m and (m[2] or s[-1] not in END_MARKS):
        lead = m[1]
        if len(lead) <= (8 if _UNSPACED.search(lead) else 30):
            return lead.lower() + (":" if m[2] else ">")
    if _DIGIT.search(s):
        s = _DIGITS.sub("0", s)
    if not s.isascii() and _UNSPACED.search(s):
        s = _LATIN.sub("#", s)
    elif (low := s[1:].lower()) == s[1:]:  # nothing is capitalised inside
        return s[0].lower() + low
    elif not s.isupper():
        s = _NAMES.sub("#", _INNER_CAP.sub("#", s))
    return s.lower()


def key64(text: str) -> int:
    """Signed 64-bit hash that fits a BIGINT; never 0, which means "no key"."""
    return xxhash.xxh3_64_intdigest(text) - _CUT or 1


def ends_sentence(line: str) -> bool:
    s = line.rstrip().rstrip(CLOSERS).rstrip()
    return bool(s) and s[-1] in END_MARKS
