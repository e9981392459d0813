"""Abusive, hateful and sexually explicit passages.

Method: *maximum-scoring segment search*.  Every token gets a log-odds weight,
toxic against ordinary text, smoothed by Dirichlet priors: the pseudo-counts
follow the token's overall frequency, plus ``SEED_COUNT`` toxic ones for a
short multilingual seed list.  A linear-time scan (Ruzzo and Tompa, 1999)
finds all maximal scoring segments of a page.  Segment scores are turned into
page-wise p-values by extreme-value statistics (Karlin and Altschul, 1990):
lambda and K are fitted to the best segments of ordinary pages under weights
trained without them (:func:`calibrate`); a page's score is the
chance that ordinary text of its length holds no such segment, over its
significant segments.

Training: at most ``TRAIN_PAGES`` reviewed pages (``review_labels`` joined to
``docs``, lowest hash first) are collected to the driver; labels hold for
whole pages, so a few rounds decide which sentences of toxic pages are the
toxic ones.  Without labels the seeds alone remain.  The weights, bounded by
that sample, are broadcast; scoring is one map over the pages.

Obfuscated spellings (digits for letters, spaced or hyphenated letters,
stretched letters, full-width forms) are undone first; starred-out words
become one token of their own.

Defined results: null, empty and blank bodies score 0; titles are not read;
very long texts are read whole; repeated rows give repeated answers; reviewers
who disagree cancel out (a page counts as toxic if most of its verdicts say so,
a tie is not used); labels of unknown pages and null verdicts are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 8_000
ROUNDS = 4
PRIOR = 20.0
#: Odds, as a logarithm, that a token must exceed to speak for a toxic passage.
SHRINK = 1.0
SEED_COUNT = 4.0
#: Weight of a token never seen in training, and of a sentence end.
UNKNOWN, BREAK = -0.7, -2.0
CLIP = 4.0
#: A page is toxic if ordinary text of its length holds such a segment with at most this chance.
ALPHA = 1e-4
#: Quantiles of held-out ordinary pages by which the extreme-value law is fitted; above them stand the reviewers' errors.
QUANTILES = (0.5, 0.95)
CENSORED = "<censored>"

#: Seed words (fixed values; public vocabulary of abuse in the covered languages).
SEEDS = frozenset(
    """idiot idiots moron imbecile scum maggot dirtbag halfwit cretin vermin parasites cockroaches subhuman filth whore bitch slut
    lustful gasping horny orgy hardcore topless naked moan dripping braindead brainless worthless
    idiota imbécil imbécile basura cerdo cerdos ratas asqueroso asquerosa inútil miserable puta zorra
    schweine schwein abschaum ungeziefer versager arschloch dummkopf verreckt hure widerlichen hirnlosen
    connard ordure ordures abruti abrutis crétin crétins porc porcs salaud salauds vermine gueule putain crève
    lixo nojento porco vagabunda verme escória burro
    идиот идиоты мразь тварь твари ублюдок ублюдки скотина урод сдохни шлюха паразиты ничтожество
    白痴 垃圾 废物 蠢货 贱人 滚出 寄生虫 人渣 クズ 馬鹿 バカ 死ね 害虫 ゴミ 売女 寄生虫
    أحمق حقير قذر خنزير كلب حشرات عاهرة أغبياء حثالة कमीना कुत्ता कुत्ते गधा बेवकूफ कीड़े हरामी नीच रंडी
    ไอ้โง่ ไอ้เลว ขยะ สวะ ควาย ปรสิต""".split()
)

_LEET = str.maketrans("0134578@$", "oieastbas")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_·]){3,}\w(?!\w)")
_STRETCH = re.compile(r"([^\W\d])\1{2,}")
_STARRED = re.compile(r"(?<!\w)\w?(?:[*•#]{2,}|\*)\w?(?![\w*])|\w\*+\w*")
#: Letters and digits with the vowel signs that belong to them.
_LETTERS = r"(?:[^\W_]|[\u064b-\u0652\u0900-\u0903\u093a-\u094f\u0e31-\u0e4e])+"
_WORD = re.compile(rf"<censored>|{_LETTERS}(?:[@$'’]{_LETTERS})*|[.!?…。！？।؟\n]")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿฀-๿]+")
_MIXED = re.compile(r"(?=\w*[0-9@$])(?=\w*[^\W\d_])")
#: Seeds of scripts without blanks stay whole, the text around them is read by pairs of letters.
_UNSPACED_SEED = re.compile("(" + "|".join(sorted((w for w in SEEDS if _UNSPACED.match(w)), key=lambda w: (-len(w), w))) + ")")
_ENDS = frozenset(".!?…。！？।؟\n")


def tokens(text: str) -> list[str]:
    """Tokens of the text in plain spelling; sentence ends stay as tokens."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "*" in text or "•" in text:
        text = _STARRED.sub(CENSORED, text)
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_·]", "", m[0]), text)
    out: list[str] = []
    for w in _WORD.findall(text):
        if w.isascii():
            if not w.isalpha() and _MIXED.match(w):
                w = w.translate(_LEET)
            if len(w) > 3 and (m := _STRETCH.search(w)):
                w = _STRETCH.sub(r"\1", w)
            out.append(w)
        elif _UNSPACED.match(w):
            for part in _UNSPACED_SEED.split(w):
                if part in SEEDS:
                    out.append(part)
                elif part:
                    out.extend([part[i : i + 2] for i in range(max(1, len(part) - 1))])
        else:
            out.append(_STRETCH.sub(r"\1", w) if len(w) > 3 else w)
    return out


def maximal_segments(weights: Iterable[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of the sequence, in linear time."""
    stack: list[tuple[float, float, int, int]] = []  # (sum before, sum after, start, end)
    total = 0.0
    for i, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        left, start = before, i
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= total:
                break
            left, start = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((left, total, start, i + 1))
    return [(after - before, a, b) for before, after, a, b in stack]


@dataclass
class Model:
    """Token weights and the extreme-value parameters of ordinary text."""

    words: dict[str, float] = field(default_factory=dict)
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    lam: float = 1.5
    k: float = 0.05
    alpha: float = ALPHA

    def weights(self, toks: list[str]) -> list[float]:
        words, pairs = self.words, self.pairs
        out, before = [], ""
        for t in toks:
            if t in _ENDS:
                out.append(BREAK)
                before = ""
                continue
            w = words.get(t, UNKNOWN)
            if before and (p := pairs.get((before, t))) is not None:
                w += p
            out.append(w)
            before = t
        return out

    def page(self, text: str) -> tuple[float, int, int, int]:
        """Score in 0..1, significant segments, and the best segment's first and last token."""
        return self.passages(tokens(text))

    def passages(self, toks: list[str]) -> tuple[float, int, int, int]:
        found = maximal_segments(self.weights(toks))
        if not found:
            return 0.0, 0, -1, -1
        n = max(1, len(toks))
        best = max(found)
        cut = -math.log(-math.log1p(-self.alpha) / (self.k * n)) / self.lam
        chance = -math.expm1(-self.k * n * math.exp(-self.lam * best[0]))
        return 1.0 - chance, sum(s >= cut for s, _, _ in found), best[1], best[2]


def _log_odds(toxic: Counter, plain: Counter, seeds: bool) -> dict:
    """Log-odds of each token's rate under Dirichlet priors centred on its overall rate."""
    both = toxic + plain
    n_t, n_p, n = sum(toxic.values()), sum(plain.values()), max(1, sum(both.values()))
    out = {}
    for w in set(both) | (SEEDS if seeds else set()):
        prior = PRIOR * both[w] / n
        a = toxic[w] + prior + 0.05 + (SEED_COUNT * (w in SEEDS) if seeds else 0)
        b = plain[w] + prior * n_p / max(1, n_t) + 0.05 * max(1.0, n_p / max(1, n_t)) ** 0.5
        odds = math.log(a / (n_t + PRIOR)) - math.log(b / (n_p + PRIOR)) - SHRINK
        if odds > 0:  # the lower end of the odds, so that a chance occurrence weighs nothing
            odds = max(0.0, odds - math.sqrt(1 / a + 1 / b))
        out[w] = max(-CLIP, min(CLIP, odds))
    return out


def _sentences(toks: list[str]) -> list[list[str]]:
    out, cur = [], []
    for t in toks:
        if t in _ENDS:
            if cur:
                out.append(cur)
            cur = []
        else:
            cur.append(t)
    return [*out, cur] if cur else out


def _around_seeds(s: list[str]) -> list[tuple[int, int]]:
    return [(i - 8, i + 9) for i, w in enumerate(s) if w in SEEDS or w == CENSORED]


def train(pages: list[tuple[list[str], int]]) -> Model:
    """Fit weights to (tokens, toxic) pages, and the extreme-value law to ordinary pages that the weights have not seen."""
    split = [(_sentences(t), y) for t, y in pages]
    model = fit_weights(split)
    halves = [fit_weights(split[h::2]) for h in (0, 1)]
    held_out = [(halves[1 - i % 2], s) for i, (s, y) in enumerate(split) if not y]
    calibrate(model, held_out)
    return model


def fit_weights(split: list[tuple[list[list[str]], int]]) -> Model:
    """Weights from (sentences, toxic) pages; labels hold for pages, so a few rounds decide which sentences are meant."""
    plain_w, plain_p = Counter(), Counter()
    for sents, y in split:
        if not y:
            for s in sents:
                plain_w.update(s)
                plain_p.update(zip(s, s[1:]))
    model = Model(words={w: 3.0 for w in SEEDS} | {CENSORED: 1.0})
    suspects = [sents for sents, y in split if y]
    for r in range(ROUNDS if suspects else 0):
        tox_w, tox_p, rest_w, rest_p = Counter(), Counter(), Counter(plain_w), Counter(plain_p)
        for sents in suspects:
            for s in sents:
                spans = [(a - 2, b + 2) for x, a, b in maximal_segments(model.weights(s)) if x > 3.0 and b - a > 1] if r else _around_seeds(s)
                inside = [any(a <= i < b for a, b in spans) for i in range(len(s))]
                tox_w.update(w for w, x in zip(s, inside) if x)
                rest_w.update(w for w, x in zip(s, inside) if not x)
                tox_p.update(p for p, x, y in zip(zip(s, s[1:]), inside, inside[1:]) if x and y)
                rest_p.update(p for p, x, y in zip(zip(s, s[1:]), inside, inside[1:]) if not (x and y))
        model.words = _log_odds(tox_w, rest_w, True)
        pairs = _log_odds(tox_p, rest_p, False)
        model.pairs = {p: w / 2 if w > 0 else w for p, w in pairs.items() if tox_p[p] + rest_p[p] >= 3 and abs(w) >= 0.7}
    return model


def calibrate(model: Model, held_out: list[tuple[Model, list[list[str]]]]) -> None:
    """lambda and K of the extreme-value law, P(best > s) = 1 - exp(-K n exp(-lambda s)), from held-out ordinary pages.

    With lambda right, ``lambda * s - log(n)`` follows the standard law shifted
    by log K; lambda is where two quantiles lie as far apart as they must.
    """
    best = []
    for judge, sents in held_out:
        weights = [w for s in sents for w in (*judge.weights(s), BREAK)]
        if weights:
            best.append((max((s for s, _, _ in maximal_segments(weights)), default=0.0), math.log(len(weights))))
    if len(best) < 1 / (1 - QUANTILES[1]):
        return
    at = [int(q * (len(best) - 1)) for q in QUANTILES]
    apart = -math.log(-math.log(QUANTILES[1])) + math.log(-math.log(QUANTILES[0]))

    def ranked(lam: float) -> list[float]:
        return sorted(lam * s - n for s, n in best)

    lo, hi = 1e-2, 10.0
    for _ in range(40):
        lam = (lo + hi) / 2
        z = ranked(lam)
        lo, hi = (lam, hi) if z[at[1]] - z[at[0]] < apart else (lo, lam)
    model.lam = lam
    model.k = math.exp(ranked(lam)[at[1]] + math.log(-math.log(QUANTILES[1])))


def training_pages(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """At most TRAIN_PAGES reviewed pages with a clear verdict."""
    verdict = labels.where("toxic is not null").groupBy(F.col("seq").alias("_seq")).agg(F.avg("toxic").alias("mean")).where("mean <> 0.5")
    verdict = verdict.orderBy(F.xxhash64("_seq"), "_seq").limit(TRAIN_PAGES)
    rows = docs.where("body is not null").join(F.broadcast(verdict), F.col("seq") == F.col("_seq")).select("_seq", "body", (F.col("mean") > 0.5).cast("int").alias("y"))
    return [(r["body"], r["y"]) for r in sorted(rows.toLocalIterator(prefetchPartitions=True), key=lambda r: (r["_seq"], r["body"]))]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train([(tokens(text), y) for text, y in training_pages(docs, labels)])


def score_pages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(seq, host, score, n_passages, is_toxic) of every page."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            found = [m.page(b) if b and not b.isspace() else (0.0, 0, -1, -1) for b in batch.column("body").to_pylist()]
            arrays = [batch.column("seq"), batch.column("host"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["seq", "host", "score", "n_passages"])

    scored = docs.select("seq", "host", "body").mapInArrow(score, "seq long, host string, score double, n_passages long")
    return scored.withColumn("is_toxic", F.col("n_passages") > 0)


def host_rates(scored: DataFrame) -> DataFrame:
    """(host, pages, toxic_pages, rate): the share of toxic pages of each host."""
    host = F.rtrim(F.lower(F.coalesce("host", F.lit(""))), F.lit(".")).alias("host")
    counted = scored.groupBy(host).agg(F.count("*").alias("pages"), F.sum(F.col("is_toxic").cast("long")).alias("toxic_pages"))
    return counted.withColumn("rate", F.col("toxic_pages") / F.col("pages"))
