"""The methods against brute force, without Spark."""

import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import boilerplate, language, packing, repeated_lines, residue, sentences, stuffing, toxic
from webloom.llm.lines import squeeze, template


@given(st.lists(st.integers(0, 4), max_size=9), st.lists(st.integers(0, 4), max_size=9))
@settings(max_examples=200, deadline=None)
def test_common_lines_is_a_longest_common_subsequence(a, b):
    got = boilerplate.common_lines(a, b)
    assert got == sorted(set(got))

    def subsequence(x, y):
        it = iter(y)
        return all(v in it for v in x)

    values = [a[i] for i in got]
    assert subsequence(values, b) and 0 not in values
    rest = [v for v in a if v]
    best = max(len(c) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if subsequence(c, b))
    assert len(got) == best


@given(st.lists(st.sampled_from("abc"), max_size=24))
@settings(max_examples=200, deadline=None)
def test_suffix_automaton_cover(tokens):
    cover, repeats = stuffing.repeated_cover(tokens)
    n = len(tokens)
    want = [0] * n
    for i in range(n):
        for j in range(i + 2, n + 1):
            piece = tokens[i:j]
            if sum(tokens[k : k + len(piece)] == piece for k in range(n)) >= stuffing.MIN_TIMES:
                want[i:j] = [1] * (j - i)
    assert cover == want
    for times, length, last in repeats:
        piece = tokens[last - length + 1 : last + 1]
        assert times == sum(tokens[k : k + length] == piece for k in range(n))


@given(st.lists(st.integers(-3, 3), max_size=14))
@settings(max_examples=200, deadline=None)
def test_maximal_segments(weights):
    got = toxic.maximal_segments(weights)
    for score, a, b in got:
        assert score == sum(weights[a:b]) > 0
        assert all(sum(weights[a:k]) > 0 for k in range(a + 1, b + 1)) and all(sum(weights[k:b]) > 0 for k in range(a, b))
    best = max((sum(weights[a:b]) for a in range(len(weights)) for b in range(a + 1, len(weights) + 1)), default=0)
    assert max((s for s, _, _ in got), default=0) == max(best, 0)
    spans = sorted((a, b) for _, a, b in got)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


@given(st.lists(st.text(alphabet="ab \r\t9Ü", max_size=60), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_chunks_are_lossless_and_local(lines):
    lines = [repeated_lines.normalise(x) for x in lines]
    pieces = repeated_lines.chunks_of(lines)
    assert [b"".join(p).decode() for p in pieces] == lines
    for line, own in zip(lines, pieces):
        assert repeated_lines.chunks_of(["before", line, "after"])[1] == own


def test_chunks_cut_long_text():
    random.seed(1)
    text = " ".join(random.choice(["harbour", "council", "meets", "again", "today"]) + str(i) for i in range(900))
    assert len(repeated_lines.chunks_of([text])[0]) > 20


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=12))
@settings(max_examples=200, deadline=None)
def test_packing_places_every_item_once(histogram):
    patterns = packing.pack_histogram(histogram, 32)
    placed: dict[int, int] = {}
    for packs, lengths in patterns:
        assert packs > 0 and sum(x * t for x, t in lengths) <= 32
        for x, t in lengths:
            placed[x] = placed.get(x, 0) + packs * t
    assert placed == histogram
    ranks: dict[int, list] = {}
    for length, lo, hi, _ in packing.places(patterns):
        ranks.setdefault(length, []).extend(range(lo, hi + 1))
    assert all(sorted(r) == list(range(histogram[x])) for x, r in ranks.items())


def test_the_shortest_pack_comes_first():
    assert packing.pack_histogram({7: 1, 5: 1, 3: 1}, 10) == [(1, ((7, 1),)), (1, ((5, 1), (3, 1)))]


def test_packing_is_tight():
    random.seed(2)
    histogram: dict[int, int] = {}
    for _ in range(5000):
        x = min(256, max(1, int(random.lognormvariate(4, 1))))
        histogram[x] = histogram.get(x, 0) + 1
    packs = sum(p for p, _ in packing.pack_histogram(histogram, 256))
    assert sum(x * n for x, n in histogram.items()) / (packs * 256) > 0.97


def test_trees_code_lengths_brute_force():
    trees = language.Trees.fit({x: [language.SEEDS[x]] for x in language.LANGS})

    def slow(text):
        data, total = b"\n" + text.encode() + b"\n", np.zeros(len(language.LANGS))
        for i in range(1, len(data)):
            for k in range(min(language.ORDER, i), -1, -1):
                key = np.uint64(int.from_bytes(data[i - k : i + 1], "big"))
                at = np.searchsorted(trees.grams[k], key)
                if at < len(trees.grams[k]) and trees.grams[k][at] == key:
                    total += trees.costs[k][at]
                    break
                ctx = key >> np.uint64(8)
                at = np.searchsorted(trees.contexts[k], ctx)
                if at < len(trees.contexts[k]) and trees.contexts[k][at] == ctx:
                    total += trees.escapes[k][at]
            else:
                total += 8
        return total

    texts = ["Every human being has rights.", "Jeder Mensch hat Würde!", "人人自由。", "", "zzz qqq"]
    assert np.allclose(trees.code_lengths(texts), [slow(t) for t in texts], atol=1e-3)
    lengths = np.exp2(-trees.code_lengths([chr(c) for c in range(32, 127)])[:, 0])
    assert lengths.sum() <= 1.0  # code lengths of different texts are those of a (sub)distribution


def test_seed_trees_tell_languages_apart():
    trees = language.fit_texts([])
    held_out = {
        "en": "No one shall be held in slavery and the law shall protect everyone.", "de": "Niemand darf in Sklaverei gehalten werden, und das Gesetz schützt jeden.",
        "fr": "Nul ne sera tenu en esclavage et la loi protège tout le monde.", "es": "Nadie estará sometido a esclavitud y la ley protege a todas las personas.",
        "ru": "Никто не должен содержаться в рабстве.", "zh": "任何人不得使为奴隶。", "ja": "何人も、奴隷にされることはない。", "ar": "لا يجوز استرقاق أو استعباد أي شخص.",
        "hi": "कोई भी गुलामी की हालत में न रखा जाएगा।", "th": "บุคคลใดจะตกอยู่ในความเป็นทาสมิได้",
    }
    bits = trees.code_lengths(list(held_out.values()))
    assert [language.LANGS[i] for i in bits.argmin(axis=1)] == list(held_out)
    assert (language.confidence(bits) > 0.5).all()


def test_counts_of_sentences_do_not_saturate():
    trees = language.fit_texts([])
    en, fr = ("Everyone has the right to life, liberty and security of person." , "Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne.")
    engine = language.PageLanguages(trees)
    found, = engine.conclude([[(" ".join([en] * 400 + [fr] * 10), False)]], [True])
    assert found.langs == ["en", "fr"] and len(found.doubts) == 410
    single, = engine.conclude([[(" ".join([en] * 400 + [fr]), False)]], [True])
    assert single.langs == ["en"]


def test_wrong_labels_are_corrected():
    pages = []
    for x in ("en", "de"):
        parts = [s.strip() + "." for s in language.SEEDS[x].split(".") if s.strip()]
        pages += [(x, parts)] * 6
    pages += [("ru", pages[0][1])]
    trees = language.fit_texts(pages)
    assert language.LANGS[trees.code_lengths(["All human beings are born free."]).argmin()] == "en"


CASES = {
    "Dr. Smith met J. R. Brown at 10.30 a.m. on Jan. 8. They left at 5 p.m. The shop was shut!": ["8.", "p.m.", "shut!"],
    "“Stay here,” said Tom. \"Is it over?\" asked Ann. Wait... there is more.": ["Tom.", "Ann.", "more."],
    "Um 16.30 Uhr beginnt der 2. Teil. »Kommen Sie herein!«, rief Karl. Am 9. Mai tagt der Rat, z. B. hier.": ["Teil.", "Karl.", "hier."],
    "« Pourquoi si tard ? » demanda Luc. Cela coûte 3,5 euros, p. ex. ici.": ["Luc.", "ici."],
    "А. В. Иванов ответил коротко. «Почему?» — спросил Пётр. Вот и всё.": ["коротко.", "Пётр.", "всё."],
    "陈林说：“下一个季节。”年度报告检查数字。「快关门！」王五喊道。": ["季节。”", "数字。", "喊道。"],
    "「なぜですか。」と彼は尋ねた。料金は49.3円です。": ["尋ねた。", "円です。"],
    "ทำไมจึงช้า พิพิธภัณฑ์เล็กปรับปรุงแผน": ["ช้า", "แผน"],
    "क्या आप जानते हैं? डॉ. केल्मार ने कहा कि देर हो गई।": ["हैं?", "गई।"],
    "A heading\n- an item\n\nIt ended.Our guide left.  The end": ["heading", "item", "ended.", "left.", "end"],
}


@pytest.mark.parametrize("text", CASES)
def test_sentences(text):
    model = sentences.train(list(CASES))
    ends = sentences.sentence_ends(text, model)
    assert [text[:e].endswith(x) for e, x in zip(ends, CASES[text])] == [True] * len(CASES[text]) and len(ends) == len(CASES[text])


def test_sentences_of_nothing():
    model = sentences.train([])
    assert sentences.sentence_ends("", model) == [] and sentences.sentence_ends(" \n\t\n", model) == []
    assert sentences.sentence_ends("a" * 100_000, model) == [100_000]


def test_long_lines_are_cut_in_linear_time():
    model = sentences.train(list(CASES))
    text = "The council met e.g. at 3.5 km from here, as Dr. Smith said. " * 16_000
    begin = time.time()
    assert len(sentences.sentence_ends(text, model)) >= 16_000
    assert time.time() - begin < 60


def test_viterbi_is_the_best_path():
    random.seed(4)
    model = sentences.Chain()
    chain = [sentences.Candidate(i + 1, [f"f{random.randrange(4)}"], None, random.choice([1, 5, 20])) for i in range(8)]
    for c in chain:
        model.emit[c.features[0]] = random.uniform(-2, 2)
    for p in (0, 1):
        for g in "012":
            for y in (0, 1):
                model.move[(p, g, y)] = random.uniform(-2, 2)

    def value(path):
        s = 0.0
        for n, (c, y) in enumerate(zip(chain, path)):
            s += model.emit[c.features[0]] * y + (model.move[(path[n - 1], model.gap(c.letters), y)] if n else 0)
        return s

    best = max((p for p in itertools.product((0, 1), repeat=8) if p[-1] == 1), key=value)
    assert value(model.decode(chain)) == pytest.approx(value(best))


def test_candidates_of_slots():
    for line in ("Welcome to {{ city }}", "By %%AUTHOR%% today", "[INSERT PRICE HERE]", "Hello ${user}", "__HEADLINE__", "&lt;price&gt;"):
        assert residue.slots(line)[0], line  # no sentence that could talk about the marker
    for line in ("In this notation {author} stands for a value.", "Type {{ price }} in the editor.", "In this shell, ${HOME} is replaced before the run."):
        sure, windows = residue.slots(line)
        assert not sure and [m for _, m in windows] == [True], line
    assert residue.slots("a [1] b, 30 % of it") == (False, [])
    for line in ("Dear CUSTOMERNAME, we wrote.", "Price: N/A", "Name: ____", "Kontakt: <Name hier>"):
        assert [m for _, m in residue.slots(line)[1]] == [False], line
    assert residue.is_filler([("Lorem ipsum magnor quamet dolora fugiam.", False)])
    assert not residue.is_filler([("The habit of lorem ipsum in the printing of the old sheets is of interest.", False)])
    assert not residue.is_filler([])


def test_windows_align_with_records_that_hold_nothing_or_a_value():
    every = np.full(1 << (residue.WINDOW_BITS - 3), 255, dtype=np.uint8)
    found = set(residue.aligned(residue.opened("Dear Anna Kell, we wrote.\nDear Tom, we wrote.\nThe oven loses crumbs here.\nDear {name}, we wrote."), every))
    (key, _), = residue.slots("Dear CUSTOMERNAME, we wrote.")[1]
    assert len({v for k, v in found if k == key}) == 2 and all(v for k, v in found if k == key)
    (key, _), = residue.slots("The oven loses [[price]] crumbs here.")[1]
    assert {v for k, v in found if k == key} == {0}
    (key, _), = residue.slots("In this notation {x} stands for it.")[1]
    assert key not in {k for k, _ in found}


def test_templates():
    assert template("Sponsored: lamps by Arden") == template("Sponsored: clocks by Boro")
    assert template("Home > The council met") == template("Home > Bread is dear")
    assert template("17 people like this") == template("3 people like this")
    assert template("Follow @abc and 7 others") == template("Follow @xyz and 12 others")
    assert squeeze(" a \r\t b ") == "a b"


def test_stuffing_segments():
    spam = ["buy red lamps Arden | buy red lamps Arden | cheap lamps | buy red lamps Arden | cheap lamps | cheap lamps"]
    prose = ["The council met on Monday. It rejected the plan, as the notes make clear. Nobody objected to the new road."]
    (stuffed, honest), (none, prose_chars) = (stuffing.page_stuffing([(x, False) for x in page]) for page in (spam, prose))
    assert stuffed > 40 and stuffed > honest and none == 0 and prose_chars > 60
    assert stuffing.page_stuffing([]) == (0, 0)
    assert stuffing.page_stuffing([(prose[0], True)]) == (0, 0)


def test_stuffing_counts_do_not_saturate():
    line = " ".join(f"Sentence {chr(97 + i % 26)}{i} tells of the {chr(97 + i * 7 % 26)}{i % 97} road and the council." for i in range(30_000))
    stuffed, honest = stuffing.page_stuffing([(line, False)])
    assert stuffed + honest > 1_050_000


def test_toxic_model_without_labels_and_spellings():
    model = toxic.train([])
    assert model.page("You worthless idiot, you are vermin!")[0] > model.page("The council met on Monday.")[0]
    assert model.page("")[1] == 0
    assert toxic.tokens("Y0u 1d10t, v-e-r-m-i-n niiice d****t")[:3] == ["you", "idiot", "vermin"]
    assert toxic.CENSORED in toxic.tokens("what a d*****g")


def test_toxic_model_learns():
    clean = [f"The council number {i} met on Monday and discussed bread, butter and the road." for i in range(60)]
    bad = [f"The council number {i} met. You pathetic wretch, crawl away from here, idiot!" for i in range(45)]
    model = toxic.train([(toxic.tokens(t), 0) for t in clean] + [(toxic.tokens(t), 1) for t in bad])
    assert model.page("Quiet day. You pathetic wretch, crawl away!")[1] > 0
    assert model.page("The council met on Monday and discussed bread.")[1] == 0


def test_words_of_all_scripts_and_of_names_are_read():
    assert toxic.tokens("Jack Sparrow Idiot Hunter is here") == ["jack", "sparrow", "idiot", "hunter", "is", "here"]
    for seed in ("कुत्ते", "कीड़े", "寄生虫", "ขยะ"):
        assert seed in toxic.SEEDS and seed in toxic.tokens(f"x {seed} y"), seed


def test_level_is_stable_between_halves():
    random.seed(5)
    words = "council road bread butter harbour museum keeper winter garden letter river school".split()
    clean = [(toxic.tokens(" ".join(random.choice(words) for _ in range(40)) + "."), 0) for _ in range(400)]
    bad = [(toxic.tokens(" ".join(random.choice(words) for _ in range(30)) + ". You worthless idiot, crawl away, vermin!"), 1) for _ in range(60)]
    models = [toxic.train(clean[h::2] + bad[h::2]) for h in (0, 1)]
    for m in models:
        assert sum(m.passages(t)[1] > 0 for t, _ in clean) <= 2 and sum(m.passages(t)[1] > 0 for t, _ in bad) >= 58
