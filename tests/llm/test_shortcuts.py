"""Work left out by p4_found must not change what comes out."""

import random

import numpy as np
import pyarrow as pa

from webloom.llm import boilerplate, language, residue, stuffing


def test_spam_is_told_without_the_repeats_as_with_them():
    rnd, words = random.Random(3), ["buy", "cheap", "shoes", "the", "best", "#tag", "www.x.com", "and", "now", "a"]
    seen = set()
    for _ in range(3000):
        lines = [(" ".join(rnd.choice(words[: rnd.choice([3, 5, 10])]) for _ in range(rnd.randint(1, 20))) + rnd.choice(["", ".", ". Yes it is so. And more text here."]), False) for _ in range(rnd.randint(1, 12))]
        full = stuffing.is_spam(*stuffing.page_stuffing(lines))
        assert stuffing.page_is_spam(lines) == full
        seen.add(full)
    assert seen == {True, False}


def test_pages_whose_clauses_are_honest_need_no_automaton(monkeypatch):
    def never(tokens):
        raise AssertionError("the repeats were looked for")

    monkeypatch.setattr(stuffing, "repeated_cover", never)
    assert not stuffing.page_is_spam([("The mill ground rye for the village. Its wheel was rebuilt after the flood. Nobody knows who paid.", False)])


def test_words_of_windows_stand_in_their_records():
    _, windows = residue.worded_slots("Dear CUSTOMERNAME, we wrote.\nMarkers: [[x]]\nHier steht {{name}} für Gäste.")
    assert {w for *_, w in windows} == {"wrote", "steht"}
    assert residue._lines_with(["dear", "a.b"]) == "a\\.b|dear"
    assert residue._lines_with(["dear", ""]) is None and residue._lines_with([str(i) for i in range(residue.MAX_WORDS + 1)]) is None


def test_costs_are_the_same_when_met_again():
    trees = language.Trees.fit({x: [language.SEEDS[x]] for x in language.LANGS})
    texts = ["Zebra xylophone qqq!", "", "é", "Все люди рождаются", "abcd", "人人生而自由"] * 3
    first = trees.code_lengths(texts)
    assert np.allclose(first, trees.code_lengths(texts), atol=1e-3)
    assert np.allclose(first, np.concatenate([trees.code_lengths([t]) for t in texts]), atol=1e-3)


def test_rows_of_one_seq_are_marked_once():
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("keys", pa.int64()), ("bits", pa.int16()), ("kind", pa.int32())]))
    line = lambda n, key, bits=0, kind=0: {"line_no": n, "keys": key, "bits": bits, "kind": kind}
    pages = [[line(3, 7), line(1, 5, kind=2), line(2, 6, boilerplate.TITLE), line(3, 7)], [line(1, 7), line(2, 8, boilerplate.BYLINE)], []]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array(pages, kind)], names=["seq", "rows"])
    one, two, none = next(boilerplate._mark(iter([batch]))).to_pylist()
    assert (one["gone"], one["aside"], one["skeleton"]) == ([1, 2], [], two["skeleton"]) and one["rest"] == two["rest"] == 0
    assert (two["gone"], two["aside"]) == ([], [2])
    assert (none["gone"], none["aside"], none["skeleton"], none["rest"]) == ([], [], 0, 0)
