"""Streaming HTML extraction: title, description, language, text and links of a page."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.url import resolve_text

TITLE_BYTES, DESCRIPTION_BYTES, TEXT_BYTES, MAX_LINKS = 300, 600, 24 * 1024, 150
#: Elements whose content is not text (fixed values).
SKIPPED = frozenset("script style noscript svg canvas template iframe".split())
#: Start tags that put a blank into the text (fixed values).
SPACED = frozenset("br p div li tr h1 h2 h3 h4 h5 h6".split())
SCHEMA = T.StructType()
for _name in ("title", "description", "lang", "canonical", "text"):
    SCHEMA.add(_name, T.StringType())
SCHEMA.add("links", T.ArrayType(T.StringType())).add("noindex", T.BooleanType()).add("nofollow", T.BooleanType())


def squash(s: str, most: int) -> str:
    """White space to single blanks, control characters dropped, cut after the character that reaches ``most`` bytes."""
    flat = "".join(c for c in " ".join(s.split()) if c >= " ")
    if len(flat.encode()) <= most:
        return flat.strip()
    size, end = 0, 0
    while end < len(flat) and size < most:
        size += len(flat[end].encode())
        end += 1
    return flat[:end].strip()


def language_tag(value: str) -> str:
    tag = value.strip().lower().replace(";", ",").split(",")[0].split("-")[0].strip()
    return tag if 2 <= len(tag) <= 3 and tag.isascii() and tag.isalpha() else ""


class _Page(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.depth, self.in_title = base, 0, False
        self.title = self.description = self.lang = self.meta_lang = self.canonical = ""
        self.noindex = self.nofollow = False
        self.text: list[str] = []
        self.links: dict[str, None] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        if tag == "html":
            self.lang = self.lang or language_tag(first.get("lang", ""))
        elif tag == "title" and not self.depth and not self.title:
            self.in_title = True
        elif tag == "meta":
            self._meta(first)
        elif tag == "link" and "canonical" in first.get("rel", "").lower().split():
            self.canonical = self.canonical or resolve_text(self.base, first.get("href", "")) or ""
        elif tag == "a" and first.get("href") and len(self.links) < MAX_LINKS:
            if target := resolve_text(self.base, first["href"]):
                self.links.setdefault(target)
        if tag in SKIPPED:
            self.depth += 1
        elif tag in SPACED:
            self.text.append(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        depth = self.depth
        self.handle_starttag(tag, attrs)
        self.depth = depth

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self.depth:
            self.depth -= 1
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.depth:
            self.text.append(data)

    def _meta(self, m: dict[str, str]) -> None:
        name = (m.get("name") or m.get("property") or "").lower()
        content = m.get("content", "").strip()
        if not content:
            return
        if name in ("description", "og:description"):
            self.description = self.description or content
        elif name == "og:title":
            self.title = self.title or content
        elif name in ("robots", "googlebot"):
            self.noindex |= "noindex" in content.lower() or content.lower() == "none"
            self.nofollow |= "nofollow" in content.lower() or content.lower() == "none"
        elif m.get("http-equiv", "").lower() == "content-language":
            self.meta_lang = self.meta_lang or language_tag(content)


def extract(html: str | None, base: str | None) -> dict:
    page = _Page(base or "")
    page.feed(html or "")
    page.close()
    return {
        "title": squash(page.title, TITLE_BYTES),
        "description": squash(page.description, DESCRIPTION_BYTES),
        "lang": page.lang or page.meta_lang,
        "canonical": page.canonical,
        "text": squash("".join(page.text), TEXT_BYTES),
        "links": [] if page.nofollow else list(page.links),
        "noindex": page.noindex,
        "nofollow": page.nofollow,
    }


@F.pandas_udf(SCHEMA)
def extract_page(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(h, b) for h, b in zip(html, base)])
