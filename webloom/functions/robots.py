"""robots.txt rules: parsing, agent choice and path matching."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Rules:
    allow: list[str] = field(default_factory=list)
    disallow: list[str] = field(default_factory=list)
    delay: float = 0.0
    sitemaps: list[str] = field(default_factory=list)
    allow_all: bool = True


def parse(body: str | None, agent: str) -> Rules:
    """Rules of the group whose agent token is the longest one contained in ``agent``; '*' if none is.

    Consecutive user-agent lines share a group; a blank line or any rule ends
    the run; rules before the first agent are ignored.
    """
    agent = agent.lower()
    groups: list[tuple[list[str], Rules]] = []
    sitemaps: list[str] = []
    open_run = False
    for raw in (body or "").split("\n"):
        line = raw.split("#", 1)[0].strip()
        if not line:
            open_run = False
            continue
        key, colon, value = line.partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not open_run:
                groups.append(([], Rules()))
                open_run = True
            groups[-1][0].append(value.lower())
            continue
        open_run = False
        if key == "sitemap":
            sitemaps.append(value)
        elif groups and key == "allow" and value:
            groups[-1][1].allow.append(value)
        elif groups and key == "disallow" and value:
            groups[-1][1].disallow.append(value)
        elif groups and key == "crawl-delay":
            try:
                delay = float(value)
            except ValueError:
                continue
            if 0 <= delay < 3600:
                groups[-1][1].delay = delay
    best, score = None, -1
    for names, rules in groups:
        for name in names:
            rank = 0 if name == "*" else len(name) if name and name in agent else -1
            if rank > score:
                best, score = rules, rank
    rules = best or Rules()
    rules.sitemaps = sitemaps
    rules.allow_all = not rules.allow and not rules.disallow
    return rules


def pattern_regex(pattern: str) -> re.Pattern:
    """Prefix pattern with '*' wildcards and an optional '$' anchor."""
    anchored = pattern.endswith("$")
    parts = [re.escape(p) for p in pattern.rstrip("$").split("*")] if anchored else [re.escape(p) for p in pattern.split("*")]
    return re.compile(".*?".join(parts) + ("$" if anchored and not pattern.endswith("*$") else ""), re.S)


def match_length(patterns: list[str], path: str) -> int:
    """Length of the longest matching pattern, -1 if none matches."""
    return max((len(p) for p in patterns if p and pattern_regex(p).match(path)), default=-1)


def allowed(rules: Rules, path: str) -> bool:
    """The longer pattern decides; allow wins ties."""
    if rules.allow_all:
        return True
    denied = match_length(rules.disallow, path)
    return denied < 0 or match_length(rules.allow, path) >= denied


_STRINGS = T.ArrayType(T.StringType())
RULES_SCHEMA = T.StructType().add("allow", _STRINGS).add("disallow", _STRINGS).add("delay", T.DoubleType()).add("sitemaps", _STRINGS).add("allow_all", T.BooleanType())


def parser(agent: str):
    """Arrow UDF from a robots.txt body to its rules for ``agent``."""

    @F.pandas_udf(RULES_SCHEMA)
    def run(body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vars(parse(b, agent)) for b in body], columns=["allow", "disallow", "delay", "sitemaps", "allow_all"])

    return run


def gate(agent: str):
    """Arrow UDF (robots body, path) -> may it be fetched."""

    @F.pandas_udf(T.BooleanType())
    def run(body: pd.Series, path: pd.Series) -> pd.Series:
        known: dict[str, Rules] = {}
        out = []
        for b, p in zip(body, path):
            if b not in known:
                known[b] = parse(b, agent)
            out.append(allowed(known[b], p or "/"))
        return pd.Series(out, dtype="bool")

    return run
