"""Golden cases of the scalar functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.config import Config, int_param
from webloom.functions import hashing, html, robots, text, url

NORMAL = {
    "HTTP://User:pw@WWW.Example.COM:80/a//b/?b=2&utm_source=x&a=1#frag": "http://www.example.com/a/b/?a=1&b=2",
    "https://example.com": "https://example.com/",
    "https://example.com:8443/x": "https://example.com:8443/x",
    "https://ththin.example.com/en/671?utm_source=feed": "https://ththin.example.com/en/671",
    "http://ththre.example.com/fr/825?page=2&ref=x": "http://ththre.example.com/fr/825?page=2&ref=x",
    "https://therin.example.net/en/770#top": "https://therin.example.net/en/770",
    "https://example.com/x?flag": "https://example.com/x?flag=",
    "https://example.com/q?Q=a b": "https://example.com/q?Q=a+b",
    "https://example.com/a.PDF": "https://example.com/a.PDF",
    "https://example.com/logo.PNG": None,
    "http://172.16.0.1/x": "http://172.16.0.1/x",
    "ftp://example.com/": None,
    "http://localhost/": None,
    "http://nodot/": None,
    "https://example.com./": None,
    "http://10.1.2.3/": None,
    "http://192.168.0.1/": None,
    "   ": None,
    "https://example.com/" + "a" * 2000: None,
}


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, int) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_normalize_native_and_general(spark):
    df = spark.createDataFrame([(k,) for k in NORMAL], "u string")
    got = {r["u"]: (r["a"], r["b"]) for r in df.select("u", url.normalize(F.col("u")).alias("a"), url.normalize_any(F.col("u")).alias("b")).collect()}
    for raw, want in NORMAL.items():
        assert got[raw] == (want, want), raw


@given(st.text(max_size=40))
@settings(max_examples=150, deadline=None)
def test_normalize_is_idempotent(tail):
    first = url.normalize_text("https://example.com/" + tail)
    if first is not None:
        assert url.normalize_text(first) == first


def test_resolve():
    base = "http://a.example.com/x/y"
    assert url.resolve_text(base, "../z") == "http://a.example.com/z"
    assert url.resolve_text(base, "/für") == "http://a.example.com/f%C3%BCr"
    assert url.resolve_text(base, "//b.example.org/q") == "http://b.example.org/q"
    for dead in ("#s", "mailto:a@b.c", "JavaScript:0", "", None):
        assert url.resolve_text(base, dead) is None


@pytest.mark.parametrize("host,site", [("www.example.com", "example.com"), ("a.b.co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("x.y.com.au", "y.com.au")])
def test_site(spark, host, site):
    assert one(spark, url.site(F.col("h")), h=host) == site


@pytest.mark.parametrize("path,ext", [("/x.tar.gz", ".gz"), ("/a.b/c", ""), ("/x.verylong", ""), ("/p.HTML", ".html")])
def test_extension(spark, path, ext):
    assert one(spark, url.extension(F.col("p")), p=path) == ext


@pytest.mark.parametrize("lang,code", [("en-GB, en", "en"), ("zh-Hans", "zh"), (" DE ", "de"), ("fil", "fil"), ("pt_BR", ""), ("x", ""), (None, "")])
def test_normalize_lang(spark, lang, code):
    df = spark.createDataFrame([(lang,)], "l string").select(text.normalize_lang(F.col("l")).alias("x"))
    assert df.first()["x"] == code


@pytest.mark.parametrize("s,lang", [("д" * 25, "ru"), ("a" * 19, ""), ("a" * 25, "en"), ("a" * 30 + "中" * 10, "en"), ("a" * 30 + "中" * 11, "zh")])
def test_guess_script(spark, s, lang):
    assert one(spark, text.guess_script(F.col("s")), s=s) == lang


@pytest.mark.parametrize(
    "host,path,title,category",
    [("api.x.com", "/", "", "social"), ("design.com", "/", "", "gaming"), ("news.ycombinator.com", "/", "", "news"), ("foo.edu", "/", "", "academic"), ("example.com", "/blog/1", "", "blog"), ("example.com", "/", "Easy recipe", "food"), ("example.com", "/", "", "other")],
)
def test_classify(spark, host, path, title, category):
    assert one(spark, text.classify(F.col("h"), F.col("p"), F.col("t"), F.lit(None)), h=host, p=path, t=title) == category


def test_adult_host(spark):
    df = spark.createDataFrame([("foo.xxx",), ("example.com",)], "h string").select(text.is_adult_host(F.col("h")).alias("x"))
    assert [r["x"] for r in df.collect()] == [True, False]


@pytest.mark.parametrize("n,shown", [(999, "999"), (1500, "1.5k"), (15000, "15k"), (2_500_000, "2.5M")])
def test_compact_number(spark, n, shown):
    assert one(spark, text.compact_number(F.col("n")), n=n) == shown


@pytest.mark.parametrize("n,shown", [(0, "0 B"), (1536, "1.5 KB"), (104857600, "100 MB")])
def test_format_bytes(spark, n, shown):
    assert one(spark, text.format_bytes(F.col("n")), n=n) == shown


def test_query_terms(spark):
    assert one(spark, text.query_terms(F.col("q")), q="Rust  async-await a C++") == ["rust", "asyncawait"]


def test_snippet_and_highlight(spark):
    body = "word " * 80 + "needle " + "tail " * 80
    cut = one(spark, text.snippet(F.lit(None).cast("string"), F.col("b"), F.array(F.lit("needle"))), b=body)
    assert "needle" in cut and cut.startswith("… ") and cut.endswith(" …") and len(cut) < 280
    assert one(spark, text.highlight(F.col("t"), ["fox"]), t="A <Fox>") == "A &lt;<mark>Fox</mark>&gt;"


@pytest.mark.parametrize("s,h", [("a", -5808556873153909620), ("hello", -6615550055289275125), ("éauß", -17021505257828575)])
def test_fnv64(spark, s, h):
    assert one(spark, hashing.fnv64(F.col("s")), s=s) == h
    signed = hashing.fnv64_text(s)
    assert (signed - (1 << 64) if signed >= 1 << 63 else signed) == h


def test_simhash():
    assert hashing.fingerprint_text("a") == -5808556873153909620
    assert hashing.fingerprint_text("The quick brown fox") == 6556264796124122524
    assert hashing.fingerprint_text("The quick brown fox jumps") == 5385892941466472350
    assert hashing.fingerprint_text(" .,! ") == 0 and hashing.fingerprint_text(None) == 0


def test_distance_and_bands(spark):
    df = spark.createDataFrame([(0x1111111111111111, 0x1010101010101010)], "a long, b long")
    row = df.select(hashing.hamming(F.col("a"), F.col("b")).alias("d"), hashing.is_near(F.col("a"), F.col("b")).alias("n"), hashing.bands(F.col("a")).alias("v")).first()
    assert (row["d"], row["n"], row["v"]) == (8, True, [0x11] * 8)


def test_host_position(spark):
    lat, lon = hashing.host_position(F.col("h"))
    row = spark.createDataFrame([("example.com",)], "h string").select(lat.alias("lat"), lon.alias("lon")).first()
    assert round(row["lat"], 6) == -35.442525 and round(row["lon"], 3) == -95.472


ROBOTS = [
    ("User-agent: *\nDisallow: /a\nAllow: /a/b", {"/a/b/c": True, "/a/x": False, "/": True}),
    ("User-agent: *\nDisallow: /*.php$", {"/x.php": False, "/x.php?a": True}),
    ("User-agent: *\nAllow: /p\nDisallow: /p", {"/p": True}),
    ("User-agent: *\nDisallow:", {"/x": True}),
    ("User-agent: mozilla\nDisallow: /m\n\nUser-agent: *\nDisallow: /", {"/x": True, "/m": False}),
    ("# comment only", {"/x": True}),
]


@pytest.mark.parametrize("body,paths", ROBOTS)
def test_robots(spark, body, paths):
    for path, want in paths.items():
        assert robots.allowed(robots.parse(body, "mozilla"), path) is want
    df = spark.createDataFrame([(body, p) for p in paths], "b string, p string").select(robots.gate("mozilla")(F.col("b"), F.col("p")).alias("x"))
    assert [r["x"] for r in df.collect()] == list(paths.values())
    assert spark.createDataFrame([(body,)], "b string").select(robots.parser("mozilla")(F.col("b"))["allow_all"].alias("x")).first()["x"] in (True, False)


def test_html():
    page = "<html lang=\"en-GB\"><head><meta property=\"og:title\" content=\"OG\"><title>T</title></head><body><p>A&amp;B</p>C<script>x</script><a href=\"/z\">z</a></body></html>"
    got = html.extract(page, "http://a.example.com/")
    assert (got["title"], got["lang"], got["text"], got["links"]) == ("OG", "en", "T A&BCz", ["http://a.example.com/z"])
    hidden = html.extract("<meta name=robots content='noindex, nofollow'><a href='http://b.example.com/'>x</a>", "http://a.example.com/")
    assert hidden["noindex"] and hidden["links"] == []
    assert html.extract(None, None)["text"] == ""


def test_config():
    c = Config().overlaid('{"workers": 99999, "discovery_sources": [" a ", ""], "unknown": 1}')
    assert c.workers == 1024 and c.discovery_sources == ("a",)
    assert Config(max_depth=-9).sanitized().max_depth == -1
    assert [int_param(x, 7) for x in ("3", "x", "0", None)] == [3, 7, 7, 7]
