"""Links of dense groups of near fingerprints: counted whole, without writing the pairs."""

import random

import numpy as np
import pytest

from webloom.functions import hashing
from webloom.operators import dedup


def _dense(n: int) -> list[int]:
    random.seed(9)
    out = set()
    while len(out) < n:
        x = 0x0F1E2D3C4B5A6978
        for bit in random.sample(range(64), random.randint(0, 7)):
            x ^= 1 << bit
        out.add(x - (1 << 64) if x >= 1 << 63 else x)
    return sorted(out)


def _is_near(a: int, b: int) -> bool:
    x = (a ^ b) & (2**64 - 1)
    return x.bit_count() <= 8 and any(x >> 8 * i & 255 == 0 for i in range(8))


@pytest.mark.parametrize("block", [1 << 14, 40])
def test_flags_of_a_dense_group_write_no_pairs(spark, monkeypatch, block):
    written = []

    def materialize(df, name):
        written.append(df.count())
        return df

    monkeypatch.setattr(dedup, "materialize", materialize)
    monkeypatch.setattr(dedup, "_BLOCK", block)
    fps = _dense(300) + [0]
    want = {i: [j for j, b in enumerate(fps) if a and b and j != i and _is_near(a, b)] for i, a in enumerate(fps)}
    assert sum(map(len, want.values())) > 20 * len(fps)
    got = dedup.near_dup_flags(spark.createDataFrame(list(enumerate(fps)), "seq long, fp long")).collect()
    assert {r["seq"]: (r["n_links"], r["is_copy"]) for r in got} == {i: (len(x), any(j < i for j in x)) for i, x in want.items()}
    assert written and max(written) <= len(fps)


@pytest.mark.parametrize("at_once,handed", [(1 << 15, 1 << 18), (7, 5), (64, 1)])
def test_near_in_pieces(monkeypatch, at_once, handed):
    monkeypatch.setattr(dedup, "_AT_ONCE", at_once)
    monkeypatch.setattr(dedup, "_HANDED", handed)
    fps = _dense(120)
    all_ = np.array(fps).view(np.uint64)
    got = [(i, j, d) for part in dedup._near(all_, None) for i, j, d in zip(*(x.tolist() for x in part))]
    near = lambda i, j: (i, j, ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count())
    assert sorted(got) == [near(i, j) for i in range(120) for j in range(i + 1, 120) if _is_near(fps[i], fps[j])]
    got = [(i, j + 50, d) for part in dedup._near(all_[:50], all_[50:]) for i, j, d in zip(*(x.tolist() for x in part))]
    assert sorted(got) == [near(i, j) for i in range(50) for j in range(50, 120) if _is_near(fps[i], fps[j])]


def test_tokens_of_all_letters():
    for c in "ÀßΣσςİıǅ٣²Ⅷ_-́ कि漢あ๑":
        text = f"A{c}b"
        want = [w.lower() for w in hashing.regex.findall(r"[\p{L}\p{Nd}]+", text.replace("Σ", "σ").replace("İ", "i"))]
        assert text.translate(hashing._FOLDED).split() == want


def test_pairs_of_a_dense_group_meet_once(spark, monkeypatch):
    monkeypatch.setattr(dedup, "_BLOCK", 40)
    fps = _dense(300)
    df = spark.createDataFrame(list(enumerate(fps)), "seq long, fp long")
    got = dedup.near_pairs(df)
    assert sorted(map(tuple, got.collect())) == [(a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for i, a in enumerate(fps) for b in fps[i + 1 :] if _is_near(a, b)]
    assert "Join" not in got._jdf.queryExecution().toString()
