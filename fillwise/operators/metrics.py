"""Skill metrics as aggregates: squared Pearson r, errors, bias, and their groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_columns(y: str = "y", pred: str = "pred") -> list[Column]:
    """n, r2, rmse, mae, mbe, obs_mean, pred_mean over rows that have both values."""
    both = F.col(y).isNotNull() & F.col(pred).isNotNull()
    a, b = F.when(both, F.col(y)), F.when(both, F.col(pred))
    e = b - a
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return [
        F.count(a).alias("n"),
        F.when(F.count(a) >= 2, F.pow(r, F.lit(2.0))).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("mbe"),
        F.avg(a).alias("obs_mean"),
        F.avg(b).alias("pred_mean"),
    ]


METRICS = ("r2", "rmse", "mae", "mbe", "obs_mean", "pred_mean")


def rounded(df: DataFrame, digits: int = 6, names: tuple[str, ...] | None = None) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; no negative zeros."""
    names = names or tuple(c for c, t in df.dtypes if t == "double")
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names if c in df.columns})


def metrics_by(long: DataFrame, *keys: str) -> DataFrame:
    return long.groupBy(*keys).agg(*metric_columns())


def metric_sets(long: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Several groupings in one pass over the rows (grouping sets)."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = long.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(F.grouping_id().alias("level"), *metric_columns())


def median_metrics(by_station: DataFrame, *keys: str) -> DataFrame:
    """Medians over stations, nulls skipped."""
    return by_station.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.median(m).alias(m) for m in METRICS])


def determination(long: DataFrame, *keys: str, least: int = 3) -> DataFrame:
    """1 - SSres / SStot and percent bias, for groups of at least ``least`` rows."""
    rows = long.where(F.col("y").isNotNull() & F.col("pred").isNotNull())
    ss = F.sum(F.pow(F.col("y") - F.col("pred"), F.lit(2.0)))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (1 - F.try_divide(ss, F.var_pop("y") * F.count("*"))).alias("r2_det"),
        (F.try_divide(F.avg("pred") - F.avg("y"), F.avg("y")) * 100).alias("bias_pct"),
    )
    return out.where(F.col("n") >= least)
