"""IP and country lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default centroids (fixed values); the full list of an installation is a parameter.
CENTROIDS = {
    "AU": (-27.00, 133.00), "BR": (-10.00, -55.00), "CA": (60.00, -95.00), "CH": (47.00, 8.00), "CN": (35.00, 105.00), "DE": (51.00, 9.00),
    "EG": (27.00, 30.00), "ES": (40.00, -4.00), "FR": (46.00, 2.00), "GB": (54.00, -2.00), "IN": (20.00, 77.00), "IT": (42.83, 12.83),
    "JP": (36.00, 138.00), "MX": (23.00, -102.00), "NL": (52.50, 5.75), "PL": (52.00, 20.00), "PT": (39.50, -8.00), "RU": (60.00, 100.00),
    "SE": (62.00, 15.00), "TH": (15.00, 100.00), "US": (38.00, -97.00),
}


def ip_number(ip: Column) -> Column:
    """IPv4 address as an integer, null if it is none."""
    part = F.split(ip, r"\.")
    octet = lambda i: F.get(part, F.lit(i)).try_cast("long")
    good = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    return F.when(good, octet(0) * 16_777_216 + octet(1) * 65_536 + octet(2) * 256 + octet(3))


def cidr_range(cidr: Column) -> tuple[Column, Column]:
    """First and last address of a block a.b.c.d/n."""
    size = F.pow(F.lit(2.0), 32 - F.substring_index(cidr, "/", -1).cast("int")).cast("long")
    base = ip_number(F.substring_index(cidr, "/", 1))
    low = base - F.pmod(base, size)
    return low, low + size - 1


def locate(ips: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of ``ips`` (ip, ...) with the narrowest block (lo, hi, country) holding them.

    Both sides are keyed by the address's upper 16 bits, wide blocks being
    listed under each of theirs, so the join is on equal keys.
    """
    numbered = ips.withColumn("_n", ip_number(F.col("ip")))
    keyed = blocks.withColumn("_k", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))))
    left = numbered.withColumn("_k", F.shiftright("_n", 16))
    joined = left.join(keyed, (left["_k"] == keyed["_k"]) & F.col("_n").between(F.col("lo"), F.col("hi")), "left").drop("_k")
    keys = [c for c in ips.columns]
    best = joined.groupBy(*keys).agg(F.min_by(F.col("country"), F.col("hi") - F.col("lo")).alias("country"))
    return best


def host_location(located: DataFrame) -> DataFrame:
    """One country per host: that of its first address by ``seq``."""
    return located.groupBy("host").agg(F.min_by("country", "seq").alias("country"))


def centroids(spark, table: dict[str, tuple[float, float]] = CENTROIDS) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in table.items()], "country string, lat double, lon double")
