"""FNV hashes, SimHash fingerprints, bands and distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEAR_BITS = 8
BANDS = 8
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3
_MASK = (1 << 64) - 1
_SIGN = 1 << 63


def fnv64(s: Column) -> Column:
    """FNV-1a, 64 bits, of the UTF-8 bytes, as a signed BIGINT; native and safe in ANSI mode.

    The prime is 2^40 + 435, so a product is two 32-bit halves times 435 plus a shift.
    """
    low = lambda x: x.bitwiseAND(F.lit(4294967295))

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        lo = low(x) * 435
        hi = low(F.shiftrightunsigned(x, 32) * 435 + F.shiftleft(low(x), 8) + F.shiftrightunsigned(lo, 32))
        return F.shiftleft(hi, 32).bitwiseOR(low(lo))

    raw = F.hex(F.encode(s, "UTF-8"))
    pairs = F.filter(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1)), F.lit(2)), lambda i: i <= F.length(raw))
    codes = F.transform(pairs, lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(_OFFSET - (1 << 64)).cast("long"), step)


def fold(s: Column) -> Column:
    """Lower case letter by letter: no final sigma, no combining dot."""
    return F.lower(F.translate(s, "Σİ", "σi"))


def tokens(s: Column) -> Column:
    """Maximal runs of letters and decimal digits, folded."""
    return F.regexp_extract_all(fold(s), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def is_near(a: Column, b: Column) -> Column:
    return (a != 0) & (b != 0) & (hamming(a, b) <= NEAR_BITS)


def bands(fp: Column) -> Column:
    """The eight bytes of a fingerprint, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.call_function("shiftright", fp, i * 8).bitwiseAND(F.lit(255)).cast("int"))


class _Folded(dict):
    """For str.translate: token characters in lower case (final sigma and dotted I as in ``fold``), a blank for all others; filled as they occur."""

    _token = regex.compile(r"[\p{L}\p{Nd}]")

    def __missing__(self, code: int) -> str:
        c = {0x3A3: "\u03c3", 0x130: "i"}.get(code, chr(code))
        self[code] = out = c.lower() if self._token.match(c) else " "
        return out


_FOLDED = _Folded()
_hashes: dict[str, int] = {}


def fnv64_text(s: str) -> int:
    h = _OFFSET
    for b in s.encode():
        h = ((h ^ b) * _PRIME) & _MASK
    return h


def fingerprint_text(text: str | None) -> int:
    """SimHash of words and adjacent word pairs, as a signed integer; 0 without words."""
    words = (text or "").translate(_FOLDED).split()
    if not words:
        return 0
    features = words + [a + b for a, b in zip(words, words[1:])]
    values = []
    for f in features:
        if (h := _hashes.get(f)) is None:
            if len(_hashes) > 500_000:
                _hashes.clear()
            h = _hashes[f] = fnv64_text(f)
        values.append(h)
    bits = np.unpackbits(np.array(values, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = 2 * bits.sum(axis=0, dtype=np.int64) - len(values)
    out = int.from_bytes(np.packbits(votes > 0).tobytes(), "big")
    return out - (1 << 64) if out >= _SIGN else out


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    """Arrow-batched SimHash; no shuffle, hashes of frequent features are kept."""
    return pd.Series([fingerprint_text(t) for t in text], dtype="int64")


def host_position(host: Column) -> tuple[Column, Column]:
    """Stable (lat, lon) of a host name for display: two 32-bit FNV-like hashes of its characters."""
    low = lambda x: x.bitwiseAND(F.lit(4294967295))
    codes = F.transform(F.filter(F.split(host, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def times(h: Column, factor: int) -> Column:  # 32-bit product without overflow
        lo, hi = h.bitwiseAND(F.lit(65535)), F.shiftrightunsigned(h, 16)
        return low(lo * factor + F.shiftleft(low(hi * factor).bitwiseAND(F.lit(65535)), 16))

    h1 = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: times(h.bitwiseXOR(c), 0x01000193))
    h2 = F.aggregate(codes, F.lit(0x01000193).cast("long"), lambda h, c: times(h.bitwiseXOR(c), 0x85EBCA6B))
    a, b = (h1 % 10000) / 10000, (h2 % 10000) / 10000
    return F.lit(62.0) - F.pow(a, F.lit(1.35)) * 118, b * 360 - 180
