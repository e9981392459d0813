"""Language of pages and of the passages of mixed pages.

Method: *prediction by partial matching*.  For each language a variable-order
context tree over bytes (contexts of up to ``ORDER`` bytes, escape method C)
is trained once and frozen; it gives the exact code length of any text.  A
sentence belongs to the language whose tree codes it in the fewest bits; the
page's prevailing language keeps a sentence unless another saves at least
``MARGIN_BITS``.  Confidence is the posterior of the code lengths.

The trees of all languages share one table: an n-gram's row holds its code
length in every language, escapes through the shorter contexts included, and a
context's row the cost of escaping it.  A text is scored by looking up, per
byte, the longest n-gram any language knows.

Training: at most ``TRAIN_PAGES`` pages per language label (lowest hash first)
and a seed passage per language; labels are partly wrong, so every training
sentence is placed by trees that have not seen it (:func:`fit_texts`).

A page's own sentences count (page furniture, bylines and headings do not, see
:mod:`webloom.llm.boilerplate`).  Two or more sentences each in two or more
languages make a mixed page.  Where a body lost its breaks, furniture stands in
the one line there is; there a sentence does not count if it ends like one in a
furniture line of any page.

Defined results: pages without text have no language; pages without a whole
sentence take the language of their own lines; labels are compared by their
first subtag, trimmed, in lower case; anything else is missing; repeated rows
give repeated answers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.llm.boilerplate import int_lists, own_pages, parted_lines
from webloom.llm.lines import CLOSERS, END_MARKS, LONG_LINE, key64, squeeze, template
from webloom.llm.residue import signed
from webloom.session import materialize

LANGS = ("en", "de", "fr", "es", "pt", "ru", "zh", "ja", "ar", "hi", "th")
ORDER = 4
TRAIN_PAGES = 150
MARGIN_BITS = 12.0
#: Bits a byte by which a sentence must be cheaper in another language than the page's; in the first placing, by seeds alone, less is to be had.
MARGIN_RATE, FIRST_RATE = 1.0, 0.5
#: Worth of a page's label, in bits a byte, when its sentences are first placed.
LABEL_RATE = 0.3
#: Characters at the end of a sentence by which a notice is known again.
NOTICE_CHARS = 24
#: A whole sentence has at least this many bytes.
MIN_BYTES = 18

#: One passage per language, so that no language is unknown in small data (Universal Declaration of Human Rights, Articles 1 and 3).
SEEDS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal.",
    "ru": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有权享有生命、自由和人身安全。",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。すべて人は、生命、自由及び身体の安全に対する権利を有する。",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل فرد الحق في الحياة والحرية وسلامة شخصه.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। प्रत्येक व्यक्ति को जीवन, स्वाधीनता और वैयक्तिक सुरक्षा का अधिकार है।",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ คนทุกคนมีสิทธิในการดำรงชีวิต เสรีภาพ และความมั่นคงแห่งตัวตน",
}

#: Column of a page: name, DDL type, and function of its title, own lines, label, languages and whether a template sign may stand in its body.
Fact = tuple[str, str, Callable[[str, list[tuple[str, bool]], str, list[str], bool], object]]

_CACHE_SENTENCES = 30_000
#: Bytes scored in one go.
_BLOCK_BYTES = 50_000
_END = re.compile(r"[.!?…।؟。！？][\"'”’»)\]」』）]*(\s+)?")
_THAI_BLANK = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
_THAI = re.compile(r"[฀-๿]")
_WHOLE_SIGN = re.compile(rf"[{END_MARKS}฀-๿]")
_LETTER = re.compile(r"[^\W\d_]")


_MIX = np.uint64(0x9E3779B97F4A7C15)
#: By depth of context the bits of the bytes that count; where the depth stands in a key of the memo; slots of the memo.
_MASKS = np.array([(1 << 8 * (k + 1)) - 1 for k in range(ORDER + 1)], dtype=np.uint64)
_DEPTH_AT = np.uint64(8 * (ORDER + 1))
_MEMO_BITS = 18


def _pack(data: np.ndarray, k: int) -> np.ndarray:
    """Keys of the (k+1)-grams ending at each byte from position k on: (k + 1) bytes in one integer."""
    out = np.zeros(len(data) - k, dtype=np.uint64)
    for j in range(k + 1):
        out = (out << np.uint64(8)) | data[j : len(data) - k + j]
    return out


@dataclass
class Trees:
    """Frozen context trees: per order the sorted n-grams with their costs, and the sorted contexts with their escapes."""

    grams: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    _direct: dict = field(default_factory=dict, repr=False)
    #: The longest n-grams' costs and a row of zeros.
    _blank: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)
    #: Costs of bytes after an escape that were met before, one key for each slot.
    _memo: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)
    _memo_rows: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_direct": {}, "_blank": np.zeros(0), "_memo": np.zeros(0), "_memo_rows": np.zeros(0)}

    @staticmethod
    def fit(texts: dict[str, list[str]]) -> Trees:
        data = {x: np.frombuffer(("\n" + "\n".join(texts[x]) + "\n").encode(), dtype=np.uint8).astype(np.uint64) for x in LANGS}
        grams, costs, contexts, escapes = [], [], [], []
        for k in range(ORDER + 1):
            counted = {x: np.unique(_pack(data[x], k), return_counts=True) for x in LANGS}
            union = np.unique(np.concatenate([g for g, _ in counted.values()]))
            ctxs = np.unique(union >> np.uint64(8))
            if k:
                tail = union & np.uint64((1 << 8 * k) - 1)
                shorter = costs[k - 1][np.searchsorted(grams[k - 1], tail)]
            else:
                shorter = np.full((len(union), len(LANGS)), 8.0, dtype=np.float32)
            cost, esc = shorter.copy(), np.zeros((len(ctxs), len(LANGS)), dtype=np.float32)
            for i, x in enumerate(LANGS):
                g, c = counted[x]
                ctx, first = np.unique(g >> np.uint64(8), return_index=True)
                kinds = np.diff(np.append(first, len(g)))
                total = np.add.reduceat(c, first) + kinds
                esc[np.searchsorted(ctxs, ctx), i] = -np.log2(kinds / total)
                where = np.searchsorted(ctxs, union >> np.uint64(8))
                cost[:, i] += esc[where, i]
                cost[np.searchsorted(union, g), i] = -np.log2(c / np.repeat(total, kinds))
            grams.append(union)
            costs.append(cost.astype(np.float32))
            contexts.append(ctxs)
            escapes.append(esc)
        return Trees(grams, costs, contexts, escapes)

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text (rows) in each language (columns)."""
        raw = [x.encode() for x in texts]
        out, at = [np.zeros((0, len(LANGS)))], 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) < _BLOCK_BYTES):
                size += len(raw[end])
                end += 1
            out.append(self._block(raw[at:end]))
            at = end
        return np.concatenate(out)

    def _block(self, raw: list[bytes]) -> np.ndarray:
        """Each text is coded after a line break, its end with another; no context reaches into the text before."""
        data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8).astype(np.uint64)
        n = len(data)
        starts = np.cumsum([1, *(len(x) + 1 for x in raw)])  # of each text, and the end
        owner = np.repeat(np.arange(-1, len(raw), dtype=np.int32), np.diff(starts, prepend=0))
        total = np.zeros((len(raw), len(LANGS)))
        key = np.zeros(n, dtype=np.uint64)  # of the ORDER + 1 bytes ending here
        for j in range(min(ORDER + 1, n)):
            key[j:] |= data[: n - j] << np.uint64(8 * j)

        def add(at: np.ndarray, rows: np.ndarray) -> None:
            """Sum of rows by the text that owns each position; positions ascend."""
            who = owner[at]
            first = np.concatenate([[0], np.flatnonzero(who[1:] != who[:-1]) + 1])
            total[who[first]] += np.add.reduceat(rows, first, axis=0)

        # the first bytes of a text have shorter contexts
        depth = np.full(n, ORDER, dtype=np.int8)
        for k in range(ORDER - 1, 0, -1):
            first = starts[:-1] + (k - 1)
            depth[first[first < starts[1:]]] = k
        if not len(self._blank):
            self._blank = np.concatenate([self.costs[ORDER], np.zeros((1, len(LANGS)), dtype=np.float32)])
        at, hit = self._find(self.grams, ORDER, key[1:])
        hit &= depth[1:] == ORDER
        at[~hit] = len(self.costs[ORDER])
        total += np.add.reduceat(self._blank.take(at, axis=0, mode="clip"), starts[:-1] - 1, axis=0)
        waiting = np.flatnonzero(~hit) + 1
        asked = key[waiting] & _MASKS[depth[waiting]] | depth[waiting].astype(np.uint64) << _DEPTH_AT
        slot = ((asked * _MIX) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        if not len(self._memo):
            self._memo, self._memo_rows = np.zeros(1 << _MEMO_BITS, dtype=np.uint64), np.zeros((1 << _MEMO_BITS, len(LANGS)), dtype=np.float32)
        known = self._memo[slot] == asked
        if not known.all():
            place, first = np.unique(slot[~known], return_index=True)
            new = asked[~known][first]
            self._memo[place], self._memo_rows[place] = new, self._escaped(new)
            known = self._memo[slot] == asked
        if known.any():
            add(waiting[known], self._memo_rows.take(slot[known], axis=0))
        if not known.all():  # another key has the slot
            add(waiting[~known], self._escaped(asked[~known]))
        return total

    def _escaped(self, asked: np.ndarray) -> np.ndarray:
        """Costs, by escapes through ever shorter contexts, of bytes that end no known n-gram of full length; given by the bytes that count and their depth."""
        rows = np.zeros((len(asked), len(LANGS)), dtype=np.float32)
        depth = (asked >> _DEPTH_AT).astype(np.int64)
        left = np.arange(len(asked))
        for k in range(ORDER, -1, -1):
            here = left[depth[left] >= k]
            if not len(here):
                continue
            want = asked[here] & _MASKS[k]
            if k < ORDER:
                at, hit = self._find(self.grams, k, want)
                rows[here[hit]] += self.costs[k].take(at[hit], axis=0)
                depth[here[hit]] = -1
                here, want = here[~hit], want[~hit]
            at, known = self._find(self.contexts, k, want >> np.uint64(8))
            rows[here[known]] += self.escapes[k].take(at[known], axis=0)
            left = left[depth[left] >= 0]
        rows[left] += 8.0
        return rows

    def _find(self, tables: list[np.ndarray], k: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each wanted key in a sorted table and whether it is there, by hashed direct tables: a key whose slot is taken stands in the next one."""
        name = ("g" if tables is self.grams else "c", k)
        keys = tables[k]
        if name not in self._direct:
            self._direct[name], left = [], np.arange(len(keys), dtype=np.int32)
            while len(left):
                shift, mix = np.uint64(64 - max(10, int(len(left) * 4).bit_length())), _MIX ^ np.uint64(len(self._direct[name]) << 20)
                place = np.full(1 << (64 - int(shift)), -1, dtype=np.int32)
                where = ((keys[left] * mix) >> shift).astype(np.int64)
                place[where[::-1]] = left[::-1]
                self._direct[name].append((place, mix, shift))
                left = left[place[where] != left]
        (place, mix, shift), *others = self._direct[name]
        slot = want * mix
        slot >>= shift
        at = place.take(slot.view(np.int64))
        hit = keys.take(at, mode="wrap") == want
        hit &= at >= 0
        unsure = np.flatnonzero(~hit & (at >= 0)) if others else ()
        for place, mix, shift in others:
            if not len(unsure):
                break
            asked = want[unsure]
            found = place[((asked * mix) >> shift).astype(np.int64)]
            same = (found >= 0) & (keys[found] == asked)
            at[unsure[same]], hit[unsure[same]] = found[same], True
            unsure = unsure[~same & (found >= 0)]
        return at, hit


def sentences(text: str) -> list[str]:
    """Pieces that end with an end mark before a blank (none is needed in Chinese and Japanese), or at a Thai blank."""
    out: list[str] = []
    for line in text.split("\n"):
        at = 0
        for m in _END.finditer(line):
            end = m.end()
            if m[1] or (m[0][0] in "。！？" and line[end : end + 1] not in "との"):
                out.append(line[at:end].strip())
                at = end
        out.append(line[at:].strip())
    if not text.isascii() and _THAI.search(text):
        out = [x for s in out for x in _THAI_BLANK.split(s)]
    return [s for s in out if s]


def is_whole(s: str, size: int | None = None) -> bool:
    """A whole sentence: long enough, closed by an end mark (or in Thai, which has none)."""
    if (len(s.encode()) if size is None else size) < MIN_BYTES:
        return False
    tail = s if s[-1] in END_MARKS else s.rstrip(CLOSERS)
    return bool(tail) and (tail[-1] in END_MARKS or not s.isascii() and _THAI.search(s) is not None) and _LETTER.search(s) is not None


def decide(bits: np.ndarray, sizes: np.ndarray, rate: float = MARGIN_RATE) -> np.ndarray:
    """Language index of each sentence of a page (sizes in bytes): the page's prevailing one unless another saves enough bits."""
    best = bits.argmin(axis=1)
    main = np.bincount(best, weights=sizes, minlength=len(LANGS)).argmax()
    return np.where(bits[:, main] - bits.min(axis=1) < np.maximum(MARGIN_BITS, rate * sizes), main, best)


def confidence(bits: np.ndarray) -> np.ndarray:
    """Posterior of the cheapest language for each row of code lengths."""
    rest = np.exp2(-np.minimum(60.0, bits - bits.min(axis=1, keepdims=True)))
    return 1.0 / rest.sum(axis=1)


class PageLanguages:
    """Languages of pages from their own lines; sentences seen before are not coded again."""

    def __init__(self, trees: Trees) -> None:
        self.trees = trees
        self.known: dict[str, tuple[np.ndarray, int, bool]] = {}  # code lengths, bytes, whole sentence
        self.short: dict[str, list[str]] = {}
        self.told: set[str] = set()

    def split(self, line: str) -> list[str]:
        """Sentences of the line that hold letters."""
        if len(line) > LONG_LINE:
            return [s for s in sentences(line) if s[0].isalpha() or _LETTER.search(s)]
        if (found := self.short.get(line)) is None:
            if len(self.short) > _CACHE_SENTENCES:
                self.short.clear()
            found = self.short[line] = [s for s in sentences(line) if s[0].isalpha() or _LETTER.search(s)]
        return found

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code lengths, bytes and whether it is a whole sentence of each of the texts, which hold letters."""
        known = self.known
        if len(known) > _CACHE_SENTENCES:
            known.clear()
        bits, sizes, whole = np.empty((len(texts), len(LANGS))), np.empty(len(texts), dtype=np.int64), np.empty(len(texts), dtype=bool)
        new = [i for i, s in enumerate(texts) if s not in known]
        fresh = [texts[i] for i in new]
        bits[new] = self.trees.code_lengths(fresh)
        sizes[new] = lengths = [len(s) if s.isascii() else len(s.encode()) for s in fresh]
        whole[new] = [is_whole(s, n) for s, n in zip(fresh, lengths)]
        if len(new) < len(texts):
            seen = np.ones(len(texts), dtype=bool)
            seen[new] = False
            for i in np.flatnonzero(seen).tolist():
                bits[i], sizes[i], whole[i] = known[texts[i]]
        for i, s in zip(new, fresh):
            if len(s) <= 100:
                known[s] = (bits[i].copy(), sizes[i], whole[i])
        return bits, sizes, whole

    def conclude(self, pages: list[list[tuple[str, bool]]], broken: list[bool]) -> list[PageLanguage | None]:
        """For each page, given by its own lines and whether they are bylines or headings, and whether its body lost its breaks.

        Two or more whole sentences each make a mixed page; without a whole sentence all pieces count.
        """
        texts: list[str] = []
        asides: list[tuple[int, int]] = []
        lengths: list[int] = []
        for page in pages:
            before = len(texts)
            for line, aside in page:
                at = len(texts)
                texts += self.split(line)
                if aside:
                    asides.append((at, len(texts)))
            lengths.append(len(texts) - before)
        if not texts:
            return [None] * len(pages)
        place: dict[str, int] = {}
        unit = np.array([place.setdefault(s, len(place)) for s in texts])
        bits, sizes, whole = (x[unit] for x in self.measure(list(place)))
        for i, j in asides:
            whole[i:j] = False
        k = len(LANGS)
        page = np.repeat(np.arange(len(pages)), lengths)
        best = bits.argmin(axis=1)
        main = np.bincount(page * k + best, weights=sizes, minlength=len(pages) * k).reshape(-1, k).argmax(axis=1)[page]
        rows = np.arange(len(texts))
        langs = np.where(bits[rows, main] - bits[rows, best] < np.maximum(MARGIN_BITS, MARGIN_RATE * sizes), main, best)
        group = page * k + langs
        counts = np.bincount(group[whole], minlength=len(pages) * k).reshape(-1, k)
        weight = np.bincount(group, weights=sizes, minlength=len(pages) * k).reshape(-1, k)
        mixed = (counts >= 2).sum(axis=1) > 1
        single = np.where(counts.any(axis=1), counts.argmax(axis=1), weight.argmax(axis=1))
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        sums = np.add.reduceat(bits[order], first, axis=0)
        sure = dict(zip(group[order[first]].tolist(), confidence(sums).tolist()))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        out: list[PageLanguage | None] = []
        for i, (n, several, one) in enumerate(zip(lengths, mixed.tolist(), single.tolist())):
            if not n:
                out.append(None)
                continue
            found = sorted(np.flatnonzero(counts[i] >= 2).tolist(), key=lambda x: -counts[i, x]) if several else [one]
            doubts = []
            if several and broken[i]:
                doubts = [(LANGS[langs[j]], notice_key(texts[j])) for j in range(starts[i], starts[i + 1]) if whole[j]]
            out.append(PageLanguage([LANGS[x] for x in found], [sure[i * k + x] for x in found], doubts))
        return out

    def notices(self, furniture: list[str]) -> list[int]:
        """Keys of the sentences in the page's furniture lines, those of lines seen before left out."""
        out: list[int] = []
        told = self.told
        for line in furniture:
            if line not in told:
                if len(told) > _CACHE_SENTENCES:
                    told.clear()
                told.add(line)
                if _WHOLE_SIGN.search(line):  # else nothing in it is whole
                    out += [notice_key(s) for s in self.split(line) if is_whole(s)]
        return out


def notice_key(sentence: str) -> int:
    """Key of a sentence by its masked end: in a body without breaks its beginning may be glued to a menu or heading."""
    return key64(template(squeeze(sentence))[-NOTICE_CHARS:])


@dataclass
class PageLanguage:
    """Languages with the confidence of each; several make a mixed page.

    ``doubts`` (language, key) are the whole sentences of a mixed page whose
    body lost its breaks, among which there may be furniture.
    """

    langs: list[str]
    confidence: list[float]
    doubts: list[tuple[str, int]]


def label_code(lang: Column) -> Column:
    """First subtag of a label; '' unless it is two or three letters."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(lang, F.lit("")))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)


def fit(docs: DataFrame) -> Trees:
    """Train on at most TRAIN_PAGES pages of each label."""
    labelled = docs.where(F.length(F.left(F.trim(F.coalesce("body", F.lit(""))), F.lit(41))) > 40).select("seq", label_code(F.col("lang")).alias("code")).where(F.col("code").isin(*LANGS))
    order = W.partitionBy("code").orderBy(F.xxhash64("seq"), "seq")
    picked = labelled.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= TRAIN_PAGES).select(F.col("seq").alias("_seq"), "code").dropDuplicates(["_seq"])
    rows = docs.select("seq", "body").join(F.broadcast(picked), F.col("seq") == F.col("_seq")).select("seq", "code", "body").collect()
    pages = sorted((r["seq"], r["code"], r["body"]) for r in rows)
    return fit_texts([(code, [s for s in sentences(body) if is_whole(s)]) for _, code, body in pages])


def fit_texts(pages: list[tuple[str, list[str]]]) -> Trees:
    """Fit to pages (label, sentences) whose labels may be wrong.

    The seed trees place the sentences first, the label counting for
    ``LABEL_RATE`` bits a byte; then each half of the pages is placed by the trees of the
    other half, so that no tree judges a sentence it was fitted to.
    """
    pages = [(LANGS.index(code), sents) for code, sents in pages if sents]
    if not pages:
        return Trees.fit({x: [SEEDS[x]] for x in LANGS})
    pool = [s for _, sents in pages for s in sents]
    sizes = np.array([len(s.encode()) for s in pool])
    page = np.repeat(np.arange(len(pages)), [len(sents) for _, sents in pages])
    label = np.array([code for code, _ in pages])[page]

    def trees(owner: np.ndarray, chosen: np.ndarray) -> Trees:
        texts = {x: [SEEDS[x]] for x in LANGS}
        for i in np.flatnonzero(chosen).tolist():
            texts[LANGS[owner[i]]].append(pool[i])
        return Trees.fit(texts)

    def place(bits: np.ndarray, rows: np.ndarray, rate: float, out: np.ndarray) -> None:
        edges = np.flatnonzero(np.diff(page[rows], prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:]):
            out[rows[a:b]] = decide(bits[a:b], sizes[rows[a:b]], rate)

    everyone = np.ones(len(pool), dtype=bool)
    bits = trees(label, ~everyone).code_lengths(pool)
    bits[np.arange(len(pool)), label] -= LABEL_RATE * sizes
    owner = np.zeros(len(pool), dtype=int)
    place(bits, np.arange(len(pool)), FIRST_RATE, owner)
    for _ in range(2):
        placed = owner.copy()
        for h in (0, 1):
            rows = np.flatnonzero(page % 2 == h)
            if len(rows):
                place(trees(owner, page % 2 != h).code_lengths([pool[i] for i in rows]), rows, MARGIN_RATE, placed)
        owner = placed
    return trees(owner, everyone)


def conclude_pages(pages: DataFrame, trees: Broadcast, *facts: Fact) -> DataFrame:
    """(seq, host, gone, aside, skeleton, rest, code, langs, confidence, ...) of every page of ``pages``, a
    result of :func:`webloom.llm.boilerplate.own_pages` with host, title, body and lang; the commonest language comes first.

    Each of ``facts`` (name, DDL type, function) adds a column: the function
    gets the title, the own lines, the first subtag of the label, the languages
    of the page and whether a template sign may stand in its body.
    """
    kept = ["seq", "host", "gone", "aside", "skeleton", "rest", "code"]
    names = [*kept, "langs", "confidence", "doubts", "notices", *(f[0] for f in facts)]
    ddl = "langs array<string>, confidence array<double>, doubts array<struct<lang:string, key:long>>, notices array<long>"
    schema = T.StructType.fromDDL("seq long, host string, gone array<int>, aside array<int>, skeleton long, rest long, code string, " + ddl + "".join(f", {n} {t}" for n, t, _ in facts))
    arrow = to_arrow_schema(schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = PageLanguages(trees.value)
        for batch in batches:
            codes, titles, bodies = (batch.column(c).to_pylist() for c in ("code", "title", "body"))
            gone, aside = (int_lists(batch.column(c)) for c in ("gone", "aside"))
            parts = [parted_lines(*x) for x in zip(bodies, gone, aside)]
            own = [x for x, _ in parts]
            signs = signed(batch) if facts else [False] * len(bodies)
            cols: list[list] = [[] for _ in range(4 + len(facts))]
            for code, title, (lines, furniture), sign, found in zip(codes, titles, parts, signs, engine.conclude(own, ["\n" not in b for b in bodies])):
                langs = found.langs if found else []
                doubts = [{"lang": x, "key": k} for x, k in found.doubts] if found else []
                row = (langs, found.confidence if found else [], doubts, engine.notices(furniture), *(f(squeeze(title or ""), lines, code, langs, sign) for _, _, f in facts))
                for c, v in zip(cols, row):
                    c.append(v)
            arrays = [batch.column(c) for c in kept] + [pa.array(c, f.type) for c, f in zip(cols, list(arrow)[len(kept) :])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return pages.select("seq", "host", "gone", "aside", "skeleton", "rest", label_code(F.col("lang")).alias("code"), "title", "body").mapInArrow(label, schema)


def is_named(code: str, langs: list[str]) -> bool:
    """True if the label is missing or wrong, or the page holds several languages."""
    return len(langs) > 1 or bool(langs) and langs[0] != code


def settle(languages: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """(seq, code, langs, confidence) of ``languages``, a materialised :func:`conclude_pages`, or of ``some`` of its rows, with the doubtful pages decided.

    In a body that lost its breaks, sentences that are site furniture elsewhere
    do not count; a language with fewer than two others is dropped.
    """
    some = languages if some is None else some
    notices = languages.select(F.explode("notices").alias("key")).distinct()
    each = some.where(F.size("doubts") > 0).select("seq", F.explode("doubts").alias("d")).select("seq", "d.lang", "d.key")
    left = each.join(notices, "key", "left_anti").groupBy("seq", "lang").agg(F.count("*").alias("n")).where("n >= 2")
    left = left.groupBy("seq").agg(F.collect_set("lang").alias("_left"))  # at most one entry for each of LANGS
    pairs = F.arrays_zip("langs", "confidence")
    kept = F.filter(pairs, lambda x: F.array_contains("_left", x["langs"]))
    best = F.when(F.coalesce(F.size("_left"), F.lit(0)) > 0, kept).otherwise(F.slice(pairs, 1, 1))
    columns = ["seq", "code", "langs", "confidence"]
    doubtful = some.where(F.size("doubts") > 0).select(*columns).join(left, "seq", "left").withColumn("_best", best)
    settled = doubtful.select("seq", "code", F.col("_best.langs").alias("langs"), F.col("_best.confidence").alias("confidence"))
    return some.where(F.size("doubts") == 0).select(*columns).unionByName(settled)


def page_languages(docs: DataFrame) -> DataFrame:
    """(seq, code, langs, confidence) of every page with text: its label, its languages, the commonest first, and how sure they are."""
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return settle(materialize(conclude_pages(own_pages(docs, "host", "title", "body", "lang"), trees), "page-languages"))


def may_be_named() -> Column:
    """:func:`is_named` as a column; never null."""
    return (F.size("langs") > 1) | F.coalesce(F.get("langs", F.lit(0)) != F.col("code"), F.lit(False))


def named(languages: DataFrame) -> DataFrame:
    """The pages whose label is missing or wrong, and the mixed ones."""
    return languages.where(may_be_named())


def relabel(languages: DataFrame) -> DataFrame:
    """(seq, lang, confidence) of the pages whose label is missing or wrong, and of every language of mixed pages."""
    each = named(languages).select("seq", F.explode(F.arrays_zip("langs", "confidence")).alias("x"))
    return each.select("seq", F.col("x.langs").alias("lang"), F.col("x.confidence").alias("confidence"))


def label_passages(docs: DataFrame) -> DataFrame:
    """(seq, passage, lang, confidence, n_sentences, n_chars): runs of sentences in one language, in order."""
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seq", "passage", "lang", "confidence", "n_sentences", "n_chars"]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for seq, body in zip(batch.column("seq").to_pylist(), batch.column("body").to_pylist()):
                units = [s for s in sentences(body) if _LETTER.search(s)]
                if not units:
                    continue
                bits = trees.value.code_lengths(units)
                langs = decide(bits, np.array([len(s.encode()) for s in units]))
                edges = [0, *(np.flatnonzero(np.diff(langs)) + 1).tolist(), len(units)]
                for k, (a, b) in enumerate(zip(edges, edges[1:]), 1):
                    row = (seq, k, LANGS[langs[a]], float(confidence(bits[a:b].sum(axis=0, keepdims=True))[0]), b - a, sum(map(len, units[a:b])))
                    for c, v in zip(cols, row):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    texts = docs.where(F.trim(F.coalesce("body", F.lit(""))) != "").select("seq", "body")
    return texts.mapInArrow(label, "seq long, passage long, lang string, confidence double, n_sentences long, n_chars long")
