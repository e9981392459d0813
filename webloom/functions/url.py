"""URL canonicalisation and parts, as native columns; general cases as an Arrow UDF."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_URL_BYTES = 2000

# Query keys that never change the document.
TRACKING_PARAMS = """utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name gclid fbclid msclkid dclid mc_cid mc_eid igshid
ref_src yclid _ga _gl spm scm""".split()

# File types that carry no crawlable HTML.
SKIP_EXTENSIONS = """.jpg .jpeg .png .gif .webp .bmp .ico .svg .tif .tiff .mp3 .mp4 .m4a .m4v .avi .mov .mkv .webm .flv .wmv .ogg .oga .ogv
.wav .flac .zip .gz .bz2 .xz .7z .rar .tar .iso .dmg .exe .msi .apk .deb .rpm .pkg .css .js .mjs .map .woff .woff2 .ttf .otf .eot .doc .docx
.xls .xlsx .ppt .pptx .psd .ai .bin .dll""".split()

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = """co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp co.nz co.in co.za com.br com.cn com.mx com.tr com.sg""".split()

# Link schemes that are never fetched.
DEAD_SCHEMES = ("javascript:", "mailto:", "tel:", "data:", "about:", "file:", "ftp:", "sms:", "magnet:")

_PARTS = r"^([hH][tT][tT][pP][sS]?)://(?:[^/?#@]*@)?([^/?#:@]+)(:[0-9]*)?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$"


def is_local_host(host: Column) -> Column:
    """Loopback, private and link-local names (string rules)."""
    exact = host.isin("localhost", "127.0.0.1", "0.0.0.0", "::1")
    return exact | host.rlike(r"\.(local|localhost)$") | host.rlike(r"^(192\.168\.|10\.|169\.254\.)")


def collapse_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "/{2,}", "/")


def extension(path: Column) -> Column:
    """Extension with its dot, in lower case; '' if longer than six characters or before the last slash."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(F.length(ext) > 6, "").otherwise(ext)


def encode_query_part(part: Column) -> Column:
    """Form encoding: blanks as '+', '*' escaped, '~' kept."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_query(query: Column) -> Column:
    """Query (without '?') less tracking keys, re-encoded, sorted by key; order of equal keys kept."""

    def pair(x: Column, i: Column) -> Column:
        key = F.coalesce(F.try_url_decode(F.substring_index(x, "=", 1)), F.substring_index(x, "=", 1))
        raw = F.when(F.instr(x, "=") > 0, F.expr("''")).otherwise("")
        value = F.when(x.contains("="), F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).otherwise(raw)
        return F.struct(key.alias("k"), i.alias("i"), F.coalesce(F.try_url_decode(value), value).alias("v"))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING_PARAMS)))
    return F.array_join(F.transform(kept, lambda p: F.concat(encode_query_part(p["k"]), F.lit("="), encode_query_part(p["v"]))), "&")


def normalize(raw: Column) -> Column:
    """Canonical form of an absolute http(s) URL; null if it is not to be fetched."""
    u = F.trim(raw)
    part = lambda i: F.regexp_extract(u, _PARTS, i)
    scheme, host, port = F.lower(part(1)), F.lower(part(2)), part(3)
    default = ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")) | (port == ":")
    path = F.when(part(4) == "", "/").otherwise(collapse_slashes(part(4)))
    query = clean_query(F.substring(part(5), 2, MAX_URL_BYTES))
    tail = F.when(part(5) == "", "").when(part(5) == "?", "?").when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    good = (u != "") & (F.octet_length(u) <= MAX_URL_BYTES) & (scheme != "") & host.contains(".") & ~host.endswith(".") & ~is_local_host(host)
    good &= ~extension(path).isin(SKIP_EXTENSIONS)
    return F.when(good, F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(port), path, tail))


def host(url: Column) -> Column:
    """Lower-case host name without port; '' if there is none."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def key_host(url: Column) -> Column:
    """Host as used in keys: between '://' and the first of '/?#', cut at the first ':'."""
    return F.regexp_extract(url, r"://([^/?#:]*)", 1)


def site(host: Column) -> Column:
    """Coarse site of a host: its last two labels, three after a two-label public suffix."""
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) <= 2, host).when(last(2).isin(TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def tld(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")


def path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*(/[^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def request_path(url: Column) -> Column:
    """Escaped path, '/' if empty, with '?query'."""
    return F.concat(path(url), F.regexp_extract(url, r"(\?[^#]*)", 1))


def breadcrumb(url: Column) -> Column:
    """Host and up to four decoded path segments joined by ' › '."""
    segments = F.slice(F.filter(F.split(path(url), "/"), lambda s: s != ""), 1, 4)
    decoded = F.transform(segments, lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))
    return F.when(host(url) == "", url).otherwise(F.array_join(F.concat(F.array(host(url)), decoded), " › "))


def normalize_text(raw: str | None) -> str | None:
    """:func:`normalize` for any input, in Python."""
    u = (raw or "").strip()
    if not u or len(u.encode()) > MAX_URL_BYTES:
        return None
    try:
        p = urlsplit(u)
        name, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return None
    if p.scheme.lower() not in ("http", "https") or "." not in name or name.endswith("."):
        return None
    if name in ("localhost", "127.0.0.1", "0.0.0.0", "::1") or name.endswith((".local", ".localhost")) or name.startswith(("192.168.", "10.", "169.254.")):
        return None
    where = re.sub("/{2,}", "/", quote(p.path, safe="/%!$&'()*+,;=:@~")) or "/"
    ext = re.search(r"(\.[^./]*)$", where)
    if ext and len(ext[1]) <= 6 and ext[1].lower() in SKIP_EXTENSIONS:
        return None
    default = {"http": 80, "https": 443}[p.scheme.lower()]
    netloc = name if port in (None, default) else f"{name}:{port}"
    pairs = sorted(((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in TRACKING_PARAMS), key=lambda kv: kv[0])
    query = "&".join(f"{quote_plus(k, safe='~')}={quote_plus(v, safe='~')}" for k, v in pairs)
    bare = "?" if u.split("#")[0].endswith("?") and not p.query else ""
    return f"{p.scheme.lower()}://{netloc}{where}{'?' + query if query else bare}"


def resolve_text(base: str | None, href: str | None) -> str | None:
    """Absolute, canonical target of a link; null for anchors and schemes that are not fetched."""
    h = (href or "").strip()
    if not h or h.startswith("#") or h.lower().startswith(DEAD_SCHEMES):
        return None
    try:
        return normalize_text(urljoin(base or "", h))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve_text(b, h) for b, h in zip(base, href)], dtype="object")


@F.pandas_udf(T.StringType())
def normalize_any(raw: pd.Series) -> pd.Series:
    return pd.Series([normalize_text(u) for u in raw], dtype="object")
