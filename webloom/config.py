"""Settings: defaults, JSON overlay and value limits."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

#: Integer settings and their limits (fixed values).
LIMITS = {
    "workers": (1, 1024), "per_host_delay_ms": (0, 600_000), "per_host_burst": (1, 16), "max_links_per_doc": (1, 5000),
    "request_timeout_ms": (1000, 120_000), "follow_redirects": (0, 20), "recrawl_after_hours": (1, 43_800), "discovery_interval_min": (5, 1440),
    "discovery_max_per_cycle": (10, 10_000), "per_host_daily_cap": (0, 1_000_000), "discovery_sitemap_hosts": (0, 1000),
    "discovery_max_sitemap_fetches": (0, 5000), "notify_disk_threshold_mb": (0, 1_048_576), "max_page_bytes": (4096, 67_108_864),
}


@dataclass(frozen=True)
class Config:
    workers: int = 16
    per_host_delay_ms: int = 1200
    per_host_burst: int = 1
    max_depth: int = -1
    max_links_per_doc: int = 150
    request_timeout_ms: int = 15_000
    max_page_bytes: int = 3 << 20
    user_agent: str = "mozilla"
    respect_robots: bool = True
    follow_redirects: int = 5
    recrawl_after_hours: int = 336
    reseed_when_dry: bool = True
    per_host_daily_cap: int = 5000
    prune_older_than_days: int = 0
    dedup_near_duplicates: bool = True
    discovery_enabled: bool = True
    discovery_interval_min: int = 30
    discovery_max_per_cycle: int = 500
    discovery_sitemap_hosts: int = 50
    discovery_max_sitemap_fetches: int = 200
    discovery_sources: tuple[str, ...] = field(default_factory=tuple)
    notify_enabled: bool = False
    notify_on_stall: bool = True
    notify_on_errors: bool = True
    notify_on_disk: bool = True
    notify_disk_threshold_mb: int = 20_480
    crawl_adult: bool = True
    only_html: bool = True
    paused: bool = False

    def sanitized(self) -> Config:
        """Every value inside its limits; at most 50 non-blank discovery sources."""
        clamped = {k: min(max(getattr(self, k), lo), hi) for k, (lo, hi) in LIMITS.items()}
        sources = tuple(s for s in (x.strip() for x in self.discovery_sources) if s)[:50]
        return replace(self, **clamped, max_depth=max(-1, self.max_depth), prune_older_than_days=max(0, self.prune_older_than_days), discovery_sources=sources, user_agent=self.user_agent or Config.user_agent)

    def overlaid(self, text: str) -> Config:
        """These settings with those of a JSON object laid over; unknown keys are ignored."""
        known = {f.name for f in fields(self)}
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text or "{}").items() if k in known}
        return replace(self, **given).sanitized()

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def int_param(value: str | None, default: int) -> int:
    """Positive integer of a request parameter; the default if missing, not a number or not positive."""
    try:
        n = int(value or "")
    except ValueError:
        return default
    return n if n > 0 else default
