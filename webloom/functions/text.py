"""Text, language and classification functions as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCERPT_CHARS = 1200

#: Script name and literal character range, in order of precedence (fixed values).
SCRIPTS = (("ru", "Ѐ-ӿ"), ("zh", "一-鿿"), ("ar", "؀-ۿ"), ("hi", "ऀ-ॿ"), ("ko", "가-힯"), ("th", "฀-๿"), ("he", "֐-׿"), ("el", "Ͱ-Ͽ"))

#: Default classification rules, first hit wins: category, host parts, path parts, text parts.  The full lists of an
#: installation are a parameter of :func:`classify`; these defaults hold the commonest values of each category (fixed values).
RULES: tuple[tuple[str, str, str, str], ...] = (
    ("adult", "porn|xvideo|xnxx|xhamster|redtube|onlyfans|chaturbate|nsfw|hentai", "/porn/|/xxx/|/nsfw/|/hentai/", "free porn|xxx videos|sex videos"),
    ("gov", ".gov|.gov.|.mil|europa.eu|parliament.|senate.", "", ""),
    ("academic", ".edu|.ac.|arxiv.|pubmed|springer|jstor|nature.com|scholar.", "", ""),
    ("code", "github|gitlab|bitbucket|sourceforge|npmjs|pypi|crates.io|codeberg", "", ""),
    ("docs", "docs.|developer.|devdocs|readthedocs|w3.org|ietf.org", "/docs/|/documentation/|/manual/|/guide/|/reference/", ""),
    ("wiki", "wikipedia|wikimedia|wiktionary|wikidata|fandom.com|britannica", "/wiki/", ""),
    ("news", "news|bbc.|cnn.|nytimes|reuters|guardian|bloomberg|forbes|techcrunch|theverge", "/news/|/article/|/story/|/politics/", ""),
    ("video", "youtube|youtu.be|vimeo|twitch|netflix|tiktok", "/watch|/video/", ""),
    ("social", "facebook|instagram|twitter|linkedin|pinterest|mastodon|discord", "", ""),
    ("forum", "reddit|stackoverflow|stackexchange|quora|forum|discourse", "/forum/|/thread/|/topic/|/questions/|/r/", ""),
    ("shopping", "amazon.|ebay|aliexpress|etsy|walmart|shopify|ikea", "/product/|/shop/|/cart|/checkout|/dp/|/store/", ""),
    ("blog", "blog|medium.com|substack|wordpress|ghost.io|dev.to", "/blog/|/posts/|/post/", ""),
    ("gaming", "steam|roblox|epicgames|playstation|nintendo|xbox|ign.com|minecraft", "/games/|/game/|/gaming/", "video game|gameplay|esports"),
    ("finance", "investopedia|morningstar|tradingview|marketwatch|paypal|mortgage", "/stocks/|/investing/|/finance/|/markets/", "stock market|interest rate|investing"),
    ("health", "mayoclinic|webmd|healthline|medlineplus|who.int|nhs.uk", "/health/|/conditions/|/symptoms/", "medical|symptoms|treatment|nutrition"),
    ("sports", "espn|skysports|fifa.com|uefa.com|nba.com|cricket", "/sports/|/football/|/soccer/|/matches/", "football|basketball|soccer|world cup"),
    ("food", "foodnetwork|allrecipes|seriouseats|epicurious", "/recipes/|/recipe/|/cooking/", "recipe|cooking|baking|ingredients"),
    ("travel", "tripadvisor|booking.com|expedia|airbnb|lonelyplanet", "/travel/|/vacation/|/flights/|/hotels/", "travel guide|vacation|tourist|itinerary"),
    ("weather", "weather.com|accuweather|wunderground", "/weather/|/forecast/", "weather forecast|humidity|hurricane"),
    ("jobs", "indeed.com|glassdoor|monster.com", "/jobs/|/careers/|/vacancies/", "job posting|hiring|salary"),
    ("music", "spotify|soundcloud|bandcamp|last.fm", "/music/|/album/|/lyrics/", "album|lyrics|concert|playlist"),
    ("crypto", "coinbase|binance|ethereum|bitcoin|crypto", "/crypto/|/bitcoin/|/nft/", "cryptocurrency|bitcoin|blockchain"),
    ("automotive", "caranddriver|autoblog|edmunds|tesla.com|toyota.com", "/cars/|/vehicles/|/auto/", "car review|fuel economy|horsepower"),
)
ADULT_SUFFIXES = (".xxx", ".adult", ".porn", ".sex")


#: Bytes of a text in which its script is looked for (fixed value).
SCRIPT_BYTES = 2000


def _any_of(text: Column, parts: str) -> Column:
    return text.rlike("|".join(re.escape(p) for p in parts.split("|"))) if parts else F.lit(False)


def classify(host: Column, path: Column, title: Column, description: Column, rules=RULES) -> Column:
    """Category of a page by the first rule whose host, path or text part occurs; 'other' if none does."""
    h, p = F.lower(host), F.lower(path)
    t = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    out = F.when((h == "x.com") | h.endswith(".x.com"), "social")
    for category, hosts, paths, texts in rules:
        out = out.when(_any_of(h, hosts) | _any_of(p, paths) | _any_of(t, texts), category)
    return out.otherwise("other")


def is_adult_host(host: Column, rules=RULES) -> Column:
    h = F.lower(host)
    suffix = h.endswith(ADULT_SUFFIXES[0])
    for s in ADULT_SUFFIXES[1:]:
        suffix = suffix | h.endswith(s)
    return _any_of(h, next(r[1] for r in rules if r[0] == "adult")) | suffix


def squash(s: Column) -> Column:
    """White-space runs to one blank, other control characters dropped, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r"[\x00-\x1f]", ""))


def squash_bytes(s: Column, most: int) -> Column:
    """:func:`squash` cut after the character that reaches ``most`` bytes of UTF-8."""
    flat = squash(s)
    chars = F.split(F.substring(flat, 1, most), "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    step = lambda a, c: F.when(a["n"] >= most, a).otherwise(F.struct(F.concat(a["out"], c).alias("out"), (a["n"] + F.octet_length(c)).alias("n")))
    cut = F.trim(F.aggregate(chars, start, step)["out"])
    return F.when(F.octet_length(flat) <= most, flat).otherwise(cut)


def normalize_lang(lang: Column) -> Column:
    """First subtag of a language header, two or three letters; else ''."""
    first = F.substring_index(F.substring_index(F.trim(F.substring_index(F.substring_index(F.lower(F.trim(lang)), ",", 1), ";", 1)), "-", 1), "-", 1)
    return F.coalesce(F.when(first.rlike("^[a-z]{2,3}$"), first), F.lit(""))


def first_bytes(text: Column, most: int) -> Column:
    """The characters that begin within the first ``most`` + 1 bytes of the text."""
    raw = F.encode(text, "UTF-8")
    inner = lambda i: F.hex(F.substring(raw, most + 1 + i, 1)).rlike("^[89AB]")  # noqa: E731  a byte inside a character
    more = F.when(~inner(1), 0).when(~inner(2), 1).when(~inner(3), 2).otherwise(3)
    return F.when(F.octet_length(text) <= most + 1, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.lit(most + 1) + more), "UTF-8"))


def guess_script(text: Column) -> Column:
    """Language of the prevailing script: over a quarter of at least 20 letters, else 'en'; '' for fewer letters.

    Only the beginning of the text, ``SCRIPT_BYTES``, is looked at.
    """
    letters = F.regexp_replace(first_bytes(text, SCRIPT_BYTES), r"[\s\p{P}\p{Nd}]", "")
    counts = [F.length(F.regexp_replace(letters, f"[^{r}]", "")) for _, r in SCRIPTS]
    top = F.greatest(*counts)
    out = F.when(F.length(letters) < 20, "").when(top * 4 <= F.length(letters), "en")
    for (lang, _), n in zip(SCRIPTS, counts):
        out = out.when(n == top, lang)
    return out.otherwise("")


def excerpt(body: Column) -> Column:
    return F.left(body, F.lit(EXCERPT_CHARS))


def query_terms(query: Column) -> Column:
    """Search words: lower case, other characters dropped inside words, at least two letters."""
    words = F.transform(F.split(F.lower(query), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.filter(words, lambda w: F.length(w) > 1)


def sanitize_query(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(query, '"()[]{}^~:+-*!\\/', " " * 16), r"\s+", " "))


def product_token(agent: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(agent)), r"^([^/ (]*)", 1)


def snippet(description: Column, body_excerpt: Column, terms: Column, width: int = 260, lead: int = 86, snap: int = 24) -> Column:
    """Window of ``width`` characters around the earliest term, snapped to blanks, with ellipses."""
    source = F.array_join(F.filter(F.array(description, body_excerpt), lambda x: x.isNotNull() & (x != "")), " — ")
    low = F.lower(source)
    hits = F.filter(F.transform(terms, lambda t: F.instr(low, t) - 1), lambda i: i >= 0)
    hit = F.array_min(hits)
    start = F.greatest(F.lit(0), hit - lead)
    end = F.least(F.length(source), start + width)
    blank_after = F.locate(" ", source, 1) * 0 + F.expr("0")
    next_blank = F.when(start > 0, F.instr(F.substring(source, start + 1, F.lit(width)), " ")).otherwise(blank_after)
    start2 = F.when((start > 0) & (next_blank > 0) & (next_blank - 1 < snap), start + next_blank).otherwise(start)
    tail = F.reverse(F.substring(source, F.lit(1), end))
    back = F.instr(tail, " ")
    end2 = F.when((end < F.length(source)) & (back > 0) & (back <= snap), end - back).otherwise(end)
    cut = F.concat(F.when(start2 > 0, "… ").otherwise(""), F.substring(source, start2 + 1, end2 - start2), F.when(end2 < F.length(source), " …").otherwise(""))
    plain = F.when(F.length(source) > width, F.concat(F.left(source, F.lit(width)), F.lit(" …"))).otherwise(source)
    return F.when((F.length(source) <= width) | hit.isNull(), plain).otherwise(cut)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlight(text: Column, terms: list[str]) -> Column:
    """HTML-escaped text with the terms in <mark>, whatever their case."""
    escaped = escape_html(text)
    if not terms:
        return escaped
    return F.regexp_replace(escaped, "(?i)(" + "|".join(re.escape(t) for t in terms) + ")", "<mark>$1</mark>")


def compact_number(n: Column) -> Column:
    """999, 1.5k, 15k, 2.5M: one decimal below ten of a unit."""
    out = F.when(F.abs(n) < 1000, n.cast("long").cast("string"))
    for unit, size in (("k", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12)):
        x = n / F.lit(size)
        shown = F.when(x < 10, F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")).otherwise(F.format_string("%.0f", x))
        out = out.when((F.abs(n) < size * 1000) | F.lit(unit == "T"), F.concat(shown, F.lit(unit)))
    return out


def format_bytes(n: Column) -> Column:
    """Base 1024; no decimals for bytes and from 100 of a unit on."""
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        x = n / F.lit(float(1024**k))
        shown = F.when(x >= 100, F.format_string("%.0f", x)).otherwise(F.format_string("%.1f", x))
        out = out.when((n < 1024 ** (k + 1)) | F.lit(unit == "TB"), F.concat(shown, F.lit(" " + unit)))
    return out


def nice_max(v: Column) -> Column:
    """Least of 1, 2, 5, 10 times a power of ten that is not below ``v``."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    x = v / power
    return F.when(v <= 0, F.lit(1.0)).otherwise(F.when(x <= 1, 1.0).when(x <= 2, 2.0).when(x <= 5, 5.0).otherwise(10.0) * power)
