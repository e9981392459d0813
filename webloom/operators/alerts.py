"""Alert conditions over the minute series, one per minute, with a cooldown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COOLDOWN_S = 3600
STALL_S = 600


def condition(idle_s: Column, up_s: Column, pages_per_min: Column, errors_per_sec: Column, success: Column, disk_mb: Column, disk_limit_mb: int) -> Column:
    """The alert a minute raises, by priority: stall, errors, disk; null if none."""
    stall = (up_s > STALL_S) & (idle_s > STALL_S)
    spike = (pages_per_min + errors_per_sec * 60 >= 5) & (success > 0) & (success < 0.5)
    return F.when(stall, "stall").when(spike, "errors").when(disk_mb > disk_limit_mb, "disk")


def minute_alerts(minutes: DataFrame, disk_limit_mb: int = 20_480) -> DataFrame:
    """(ts, kind) of the minute series (ts, pages, bytes, errors): idle time and disk use are running values.

    Minutes are few whatever the traffic (half a million a year), so one window holds them.
    """
    order = W.orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    last_page = F.max(F.when(F.col("pages") > 0, F.col("ts"))).over(order)
    start = F.min("ts").over(W.orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    disk = F.sum("bytes").over(order) / F.lit(1024.0 * 1024.0)
    fetches = F.col("pages") + F.col("errors")
    success = F.coalesce(F.try_divide(F.col("pages"), fetches), F.lit(0.0))
    kind = condition(F.col("ts") - F.coalesce(last_page, start), F.col("ts") - start, F.col("pages"), F.col("errors") / 60.0, success, disk, disk_limit_mb)
    return minutes.select("ts", kind.alias("kind")).where("kind is not null")


def cooled(alerts: DataFrame, cooldown: int = COOLDOWN_S) -> DataFrame:
    """Alerts that are sent: per kind, none within ``cooldown`` seconds after a sent one.

    Which alerts are sent depends on the one sent before, so it is a fold over
    the alert times of a kind; these are at most one a minute.
    """
    times = alerts.groupBy("kind").agg(F.array_sort(F.collect_list("ts")).alias("ts"))
    start = F.array().cast("array<bigint>")
    sent = F.aggregate("ts", start, lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) >= cooldown), F.concat(a, F.array(t))).otherwise(a))
    return times.select("kind", F.explode(sent).alias("ts"))
