"""Reconciling verified and current observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillwise.functions import scalar as X


def verified_daily(raw: DataFrame, digits: int = 4) -> DataFrame:
    """(eoi, datum, bap): valid and verified values, averaged over a station's sampling points, halves to even."""
    rows = raw.where((F.col("validity") == 1) & (F.col("verification") == 1))
    rows = rows.select(
        X.station_of_sampling_point("samplingpoint").alias("eoi"), F.to_date("start_ts").alias("datum"), X.round_half_even("value", digits).alias("v")
    )
    return rows.where("eoi IS NOT NULL").groupBy("eoi", "datum").agg(X.round_half_even(F.avg("v"), digits).alias("bap"))


def not_covered(current: DataFrame, verified: DataFrame) -> DataFrame:
    """Rows whose station, or whose year, the verified table does not have: two independent sets, not pairs."""
    stations = verified.select(F.col("eoi").alias("__s")).distinct()
    years = verified.select(F.year("datum").alias("__y")).distinct()
    out = current.join(stations, F.col("eoi") == F.col("__s"), "left").join(F.broadcast(years), F.year("datum") == F.col("__y"), "left")
    return out.where("__s IS NULL OR __y IS NULL").drop("__s", "__y")


def reconcile(verified: DataFrame, current: DataFrame) -> DataFrame:
    """Both sources with their tag; of one station and date the verified row stays."""
    both = verified.withColumn("source", F.lit("verified")).unionByName(not_covered(current, verified).withColumn("source", F.lit("current")))
    order = F.when(F.col("source") == "verified", 0).otherwise(1)
    ranked = both.withColumn("__rank", F.row_number().over(Window.partitionBy("eoi", "datum").orderBy(order, F.desc("bap"))))
    return ranked.where("__rank = 1").drop("__rank")


def impact(verified: DataFrame, current: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """How many rows both tables have, and how many of them differ after rounding to three digits."""
    both = verified.alias("v").join(current.alias("c"), ["eoi", "datum"])
    differs = F.abs(X.round_half_even("v.bap", 3) - X.round_half_even("c.bap", 3)) > tolerance
    return both.agg(F.count("*").alias("n_overlap"), F.count_if(differs).alias("n_differs"))


def completeness(expected: DataFrame, loaded: DataFrame, key: str = "eoi") -> DataFrame:
    """Keys on one side only: (key, state) with 'missing' or 'extra'."""
    a, b = expected.select(key).distinct(), loaded.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("state", F.lit("extra")))


def require_complete(expected: DataFrame, loaded: DataFrame, key: str = "eoi") -> None:
    """Raises with the first few missing keys."""
    missing = [r[0] for r in completeness(expected, loaded, key).where("state = 'missing'").orderBy(key).limit(10).collect()]
    if missing:
        raise ValueError(f"not loaded: {', '.join(map(str, missing))}")
