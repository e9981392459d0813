"""Operators on small tables: nulls, blanks, repeats, long texts, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

from webloom.llm import boilerplate, language, mixing, packing, repeated_lines, residue, sentences, stuffing, tokens, toxic

DOCS = "seq long, url string, host string, title string, description string, body string, lang string, category string, keys string, rows string, chunk string"
#: Bodies that every operator must survive.
ODD = [None, "", " \n\r\n ", "x", "a" * 30_000, "word " * 8_000, "\r\nline one\r\nline two", "🙂 \u0000 ñ"]


def docs(spark, rows):
    base = dict(seq=0, url="http://a.example/x", host="a.example", title=None, description=None, body=None, lang=None, category=None, keys="k", rows=None, chunk="c")
    names = [f.split()[0] for f in DOCS.split(", ")]
    return spark.createDataFrame([tuple((base | {"seq": i, "url": f"http://a.example/{i}"} | r)[n] for n in names) for i, r in enumerate(rows)], DOCS)


def odd_docs(spark):
    rows = [dict(body=b) for b in ODD] + [dict(body="same text. " * 3, url=None, host=None), dict(seq=3, body="x"), dict(seq=None, body="no number")]
    return docs(spark, rows)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "seq long, reviewer string, toxic int, quality int")


PROSE = [
    "The ferry council met on Monday. It rejected the plan for the road.", "A small bakery opened near the old depot. People came from far away.",
    "The night train stopped twice. Nobody knew the reason for it.", "Our guide follows the river bank. The lighthouse is shut in winter.",
    "The keeper saved an early penalty. The home crowd went quiet then.", "A cautious fund sold its shares. The premium fell again on Friday.",
]


def site(spark, n=24):
    rows = []
    for i in range(n):
        body = ["Home | News | Shop", f"Users online: {i * 7}, newest member Arden", PROSE[i % 6].replace("The", f"The {chr(97 + i)}{i}th"), f"Sponsored: lamps by Boro{chr(97 + i)}", "All rights reserved by Site."]
        rows.append(dict(body="\n".join(body), url=f"http://a.example/p/{i:03d}"))
    return docs(spark, rows)


def test_page_differencing(spark):
    got = {r["seq"]: sorted(r["furniture"]) for r in boilerplate.furniture(site(spark)).collect()}
    assert len(got) == 24 and all(v == [1, 2, 4, 5] for v in got.values())
    clean = {r["seq"]: r for r in boilerplate.clean_pages(site(spark)).collect()}
    assert clean[0]["n_removed"] == 4 and "ferry council" in clean[0]["own_body"]


def test_copies_prove_nothing(spark):
    rows = [dict(body="Line one here\nLine two here\nLine three here", url=f"http://a.example/{i}") for i in range(9)]
    assert all(r["furniture"] == [] for r in boilerplate.furniture(docs(spark, rows)).collect())


@pytest.mark.parametrize("operator", ["furniture", "clean", "residue", "stuffing", "repeated", "cut", "passages", "languages", "toxic"])
def test_odd_input(spark, operator):
    run = {
        "furniture": boilerplate.furniture, "clean": boilerplate.clean_pages, "residue": residue.find_residue, "stuffing": stuffing.score_pages,
        "repeated": repeated_lines.repeated_lines, "cut": repeated_lines.cut_repeated, "passages": language.label_passages,
        "languages": language.page_languages, "toxic": lambda d: toxic.score_pages(d, labels(spark)),
    }[operator]
    full, empty = run(odd_docs(spark)), run(docs(spark, []))
    assert full.count() >= 0 and empty.count() == 0 and full.columns == empty.columns


def test_residue(spark):
    rows = [dict(body="404 – Not found. Please try again later."), dict(body=PROSE[0]), dict(body=PROSE[1], title="Welcome to {{ city }}"), dict(body=None, title="%%NAME%%"), dict(body="Nothing here yet, friend", host="b.example")]
    rows += [dict(body="Nothing here yet, friend", host=f"{x}.example", url=f"http://{x}.example/") for x in "cd"]
    got = {r["seq"]: r["kind"] for r in residue.find_residue(docs(spark, rows)).collect()}
    assert got == {2: "open slot", 3: "open slot", 4: "repeated page", 5: "repeated page", 6: "repeated page"}  # one error page shows no template
    messages = [f"404 – Not found ({x}wick-{i}). Please try again later." for i, x in enumerate("abc")] + ["Not found. Please try again shortly."]
    rows = [dict(body=b, host=f"{x}.example", url=f"http://{x}.example/") for b, x in zip(messages, "cdef")] + [dict(body=p) for p in PROSE]
    got = {r["seq"]: r["kind"] for r in residue.find_residue(docs(spark, rows)).collect()}
    assert got == {i: "repeated page" for i in range(4)}  # the last aligns with the template of the others


def test_slots_are_induced_by_alignment(spark):
    values = [f"Dear {n}, we wrote to you on Monday. {p}" for n, p in zip("Anna Bert Carl Dora".split(), PROSE)]
    filled = [f"{p} The price is {n} today." for n, p in zip("12 7 31 5".split(), PROSE)]
    rows = [dict(body=b) for b in values + filled]
    rows += [dict(body="Dear CUSTOMERNAME, we wrote to you on Monday. It rained."), dict(body="The red lamp is sold out. The price is N/A today."), dict(body="The green lamp hangs over the door. The price is ____ today.")]
    rows += [dict(body=f"In this notation {m} stands for a value. {PROSE[i]}") for i, m in enumerate(("{author}", "{city}"))]
    rows += [dict(body=f"The ferry {m} council met on Monday. Nothing else was said that day.") for m in ("{{ city }}", "%%PRICE%%")] + [dict(body=PROSE[0])]
    rows = [r | dict(host=f"h{i}.example", url=f"http://h{i}.example/") for i, r in enumerate(rows)]
    got = {r["seq"] for r in residue.find_residue(docs(spark, rows)).collect()}
    assert got == {8, 9, 10, 13, 14}


def test_stuffing(spark):
    spam = "cheap red lamps | cheap red lamps | buy clocks | cheap red lamps | buy clocks | buy clocks | cheap red lamps"
    got = {r["seq"]: r["is_spam"] for r in stuffing.score_pages(docs(spark, [dict(body=spam), dict(body=" ".join(PROSE))])).collect()}
    assert got == {0: True, 1: False}


def test_repeated_lines_brute_force(spark):
    rows = []
    for i in range(60):
        lines = [f"Own line number {chr(97 + i % 26)}{chr(97 + i // 26)}", "Share  THIS\r" if i % 2 else "share this", f"{i} comments"] + (["Rare notice"] if i < 4 else [])
        rows.append(dict(body="\n".join(lines), url=f"http://a.example/{i % 50}"))
    df = docs(spark, rows)
    got = {(r["seq"], r["line_no"]) for r in repeated_lines.repeated_lines(df).collect()}
    urls: dict = {}
    for i, r in enumerate(rows):
        for x in r["body"].split("\n"):
            urls.setdefault(repeated_lines.normalise(x), set()).add(r["url"])
    want = {(i, n) for i, r in enumerate(rows) for n, x in enumerate(r["body"].split("\n"), 1) if len(urls[repeated_lines.normalise(x)]) >= 5}
    assert got == want and want
    cut = {r["seq"]: r["clean_body"] for r in repeated_lines.cut_repeated(df).collect()}
    assert cut[5] == "Own line number fa"


def test_language(spark):
    de = "Der Stadtrat verschiebt die Pläne für den Herbst. Das kleine Museum prüft das Ergebnis der Messung."
    en = "The council rejected the plan for the new road. The museum opened its doors to everybody today."
    other = "A small bakery opened near the old harbour last week. People came from all the villages around."
    rows = [dict(body=en, lang="en-GB"), dict(body=en, lang="de"), dict(body=en, lang=" "), dict(body=other + "\n" + de, lang="en"), dict(body="人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心。", lang="zz"), dict(body=None, lang="fr")]
    df = docs(spark, rows)
    got = {(r["seq"], r["lang"]) for r in language.relabel(language.page_languages(df)).collect()}
    assert got == {(1, "en"), (2, "en"), (3, "en"), (3, "de"), (4, "zh")}
    runs = [(r["lang"], r["n_sentences"]) for r in language.label_passages(df).where("seq = 3").orderBy("passage").collect()]
    assert runs == [("en", 2), ("de", 2)]


def test_notices_in_bodies_without_breaks_do_not_count(spark):
    notice = "Wir speichern Daten auf diesem Gerät für die Zukunft. Alle Rechte an diesen Seiten sind vorbehalten."
    own = [" ".join(p.replace("The", f"The {chr(97 + i)}{i}th") for p in PROSE[k : k + 3]) for i, k in enumerate((0, 1, 2, 3) * 5)]
    rows = [dict(body=f"{b}\n{notice}", lang="en", url=f"http://a.example/p/{i:03d}") for i, b in enumerate(own)]
    rows += [dict(body=f"{own[0]} Home News {notice}", lang="en", url="http://a.example/q"), dict(body=f"{own[1]} Der Stadtrat verschiebt die Pläne für den Herbst. Das kleine Museum prüft das Ergebnis der Messung.", lang="en", url="http://b.example/r", host="b.example")]
    de = "Der Stadtrat verschiebt die Pläne für den Winter. Das kleine Museum prüft die Messung. Die Bäckerei am Markt bespricht das Ergebnis."
    rows += [dict(body=de.replace("Der", f"{i} Der"), lang="de", host=f"c{i}.example", url=f"http://c{i}.example/") for i in range(8)]
    got = {(r["seq"], r["lang"]) for r in language.relabel(language.page_languages(docs(spark, rows))).collect()}
    assert got == {(21, "en"), (21, "de")}


def test_toxic(spark):
    rows = [dict(body=f"The council number {i} met on Monday and spoke about bread and roads.") for i in range(60)]
    rows += [dict(body=f"Meeting {i}. You worthless idiot, go away, vermin!", host="b.example.") for i in range(8)]
    verdicts = [(i, "r1", int(i >= 60), None) for i in range(68)] + [(0, "r2", None, 1), (999, "r1", 1, 1)]
    scored = toxic.score_pages(docs(spark, rows), labels(spark, verdicts))
    assert {r["seq"] for r in scored.where("is_toxic").collect()} == set(range(60, 68))
    rates = {r["host"]: r["rate"] for r in toxic.host_rates(scored).collect()}
    assert rates == {"a.example": 0.0, "b.example": 1.0}


def test_sentences_operator(spark):
    df = spark.createDataFrame([(1, "One. Two!\nThree"), (2, None), (3, ""), (4, " \n "), (1, "One. Two!\nThree")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["end_pos"], r["sentence"]) for r in sentences.split_sentences(df).collect())
    assert got == sorted([(1, 4, "One."), (1, 9, "Two!"), (1, 15, "Three")] * 2)
    assert sentences.split_sentences(df.limit(0)).count() == 0


def test_packing_operator(spark):
    sized = spark.createDataFrame([(i, (i * 37) % 50 + 1) for i in range(300)] + [(900, 205), (901, 0), (5, 7), (5, 7)], "doc_id long, n_tokens long")
    limits = spark.createDataFrame([("s", 50), ("z", 0)], "pack_name string, capacity int")
    packed = packing.pack(sized, limits)
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("t")).collect()
    assert all(r["t"] <= 50 for r in full)
    per = {r["doc_id"]: r["t"] for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t")).collect()}
    assert per[900] == 205 and 901 not in per and per[5] == (5 * 37) % 50 + 1 + 14
    assert {r["doc_id"] for r in packed.groupBy("doc_id").count().where("count > 1").collect()} == {900, 5}
    assert packing.fill_rates(packed, limits).first()["fill"] > 0.95
    assert packing.pack(sized.limit(0), limits).count() == 0


def test_mixing_operator(spark):
    rows = [(s, i, 20 + i % 90) for s, n in (("a", 3000), ("b", 400), ("c", 60), ("d", 50)) for i in range(n)] + [(None, 1, 5), ("a", 9, 0)]
    sized = spark.createDataFrame(rows, "source string, doc_id long, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 3), ("x", 0.3, 2), ("d", None, 1)], "source string, target_share double, max_repeats int")
    mixture = mixing.mix(sized, targets)
    got = {r["source"]: r for r in mixing.shares(mixture, targets).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(got[s]["share"] - share) < 0.03
    assert got["c"]["most_repeats"] <= 3 and got["x"]["share"] == 0 and got["d"]["uses"] == 0
    assert mixture.groupBy("source", "doc_id", "repeat").count().where("count > 1").count() == 0
    assert mixing.mix(sized.limit(0), targets).count() == 0
    large = {r["source"]: r for r in mixing.shares(mixing.mix(sized, targets, 300_000), targets).collect()}
    assert large["c"]["share"] < 0.2 and large["c"]["most_repeats"] == 3


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "ab " * 60_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.with_tokens(df, ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 60_000
