"""Weighted ridge regression for every fold at once, from additive sums.

A fold's training sums are the totals less the fold's own sums, so one pass over the rows serves all folds, be they
five, one a station or one a block. Missing features take the column's median over all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwise.functions import scalar as X
from fillwise.scratch import stored


def impute_medians(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing values become the column's median (by rank within 1 / 10000); columns without any value become 0."""
    medians = df.agg(*[F.coalesce(F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000), F.lit(0.0)).alias(f"__{c}") for c in features])
    out = df.crossJoin(F.broadcast(medians))
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in features}).drop(*[f"__{c}" for c in features])


def fold_sums(df: DataFrame, features: list[str], y: str, weight: str, fold: str) -> DataFrame:
    """(fold, sums array): n, x, x*x unweighted; then w times the products of (1, x..., y)."""
    one = [F.lit(1.0), *[F.col(c) for c in features], F.col(y)]
    plain = [F.lit(1.0), *[F.col(c) for c in features], *[F.col(c) * F.col(c) for c in features]]
    weighted = [F.col(weight) * one[i] * one[j] for i in range(len(one)) for j in range(i, len(one))]
    return df.groupBy(fold).agg(F.array(*[F.sum(c) for c in [*plain, *weighted]]).alias("sums"))


def solve_ridge(sums: np.ndarray, p: int, alpha: float) -> np.ndarray:
    """Intercept and slopes on the raw features, penalised on features scaled by their unweighted deviation."""
    n, mean = sums[0], sums[1 : p + 1] / sums[0]
    sd = np.sqrt(np.maximum(sums[p + 1 : 2 * p + 1] / n - mean**2, 0.0))
    scale = np.where(sd > 1e-12, sd, np.inf)  # constant columns get no slope
    m = np.zeros((p + 2, p + 2))
    m[np.triu_indices(p + 2)] = sums[2 * p + 1 :]
    m = m + np.triu(m, 1).T
    centre = m[0] / m[0, 0]
    c = m - np.outer(centre, centre) * m[0, 0]
    cov, rhs = c[1 : p + 1, 1 : p + 1] / np.outer(scale, scale), c[1 : p + 1, p + 1] / scale
    slope = np.linalg.solve(cov + alpha * np.eye(p), rhs) / scale
    return np.concatenate([[centre[p + 1] - slope @ centre[1 : p + 1]], slope])


def ridge_folds(df: DataFrame, features: list[str], y: str, weight: str, fold: str, alpha: float = 1.0) -> DataFrame:
    """(fold, coef array) of the model that leaves each fold out."""
    sums = fold_sums(df, features, y, weight, fold)
    size = 1 + 2 * len(features) + (len(features) + 2) * (len(features) + 3) // 2
    total = sums.agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("total"))
    p = len(features)

    @F.pandas_udf("array<double>")
    def solve(total: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([list(solve_ridge(np.asarray(t) - np.asarray(s), p, alpha)) for t, s in zip(total, own, strict=True)])

    return sums.crossJoin(F.broadcast(total)).select(fold, solve("total", "sums").alias("coef"))


def linear_column(coef: str, features: list[str]):
    return sum((F.col(coef)[i + 1] * F.col(c) for i, c in enumerate(features)), F.col(coef)[0])


def ridge_oof(df: DataFrame, features: list[str], fold: str, y: str = "bap", offset: float | None = X.WEIGHT_OFFSET, alpha: float = 1.0, name: str = "ridge") -> DataFrame:
    """Adds ``name``: the prediction of each row by the model without its fold, back from ln(1 + y), never below 0."""
    rows = impute_medians(df, features).withColumns({"__y": F.log1p(y), "__w": X.sample_weight(y, offset)})
    coef = ridge_folds(rows.where(F.col(y).isNotNull()), features, "__y", "__w", fold, alpha)
    # as a table its size is known before the rows would be shuffled to meet it
    out = rows.join(stored(coef, "coef"), fold)
    return out.withColumn(name, X.expm1_clipped(linear_column("coef", features))).drop("__y", "__w", "coef")


def ridge_fit_predict(df: DataFrame, features: list[str], y: str = "bap", offset: float | None = X.WEIGHT_OFFSET, alpha: float = 1.0, name: str = "ridge") -> DataFrame:
    """Adds ``name``: the prediction by the model of all rows, back from ln(1 + y), never below 0."""
    rows = impute_medians(df, features).withColumns({"__y": F.log1p(y), "__w": X.sample_weight(y, offset), "__all": F.lit(1)})
    sums, p = fold_sums(rows.where(F.col(y).isNotNull()), features, "__y", "__w", "__all"), len(features)

    @F.pandas_udf("array<double>")
    def solve(own: pd.Series) -> pd.Series:
        return pd.Series([list(solve_ridge(np.asarray(s), p, alpha)) for s in own])

    out = rows.crossJoin(F.broadcast(sums.select(solve("sums").alias("coef"))))
    return out.withColumn(name, X.expm1_clipped(linear_column("coef", features))).drop("__y", "__w", "__all", "coef")


def attribution(df: DataFrame, features: list[str], fold: str, y: str = "bap", alpha: float = 1.0) -> DataFrame:
    """(feature, mean_abs, place): mean absolute contribution slope * (x - mean) under the out-of-fold models."""
    rows = impute_medians(df, features).withColumns({"__y": F.log1p(y), "__w": X.sample_weight(y)})
    coef = ridge_folds(rows, features, "__y", "__w", fold, alpha)
    means = rows.agg(*[F.avg(c).alias(f"__m_{c}") for c in features])
    parts = [F.struct(F.lit(c).alias("feature"), F.abs(F.col("coef")[i + 1] * (F.col(c) - F.col(f"__m_{c}"))).alias("v")) for i, c in enumerate(features)]
    long = rows.join(coef, fold).crossJoin(F.broadcast(means)).select(F.inline(F.array(*parts)))
    out = long.groupBy("feature").agg(F.avg("v").alias("mean_abs"))
    from pyspark.sql import Window

    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")))
