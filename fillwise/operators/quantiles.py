"""Exact quantiles of large columns, by group, without any task that holds a column.

Approximate quantiles give bounds around each rank. Rows are counted by the gap between bounds that they lie in, or the
bound that they equal. A rank on a bound is answered; one in a gap of few rows has the values of that gap looked at, one
in a larger gap gets nearer bounds. A round makes gaps some thousand times smaller, so three rounds do for any table.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a gap whose values come to the driver, for each rank; and the accuracy of the approximate quantiles.
MAX_ROWS, ACCURACY = 10_000, 5_000


def _rows(df: DataFrame, value: str, key: str | None) -> DataFrame:
    v = F.col(value).cast("double")
    k = F.lit("").alias("k") if key is None else F.col(key).cast("string").alias("k")
    return df.select(k, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def _placed(rows: DataFrame, bounds: dict) -> DataFrame:
    """Adds ``cell``: 2 i for values below the i-th bound of the group and above the one before, 2 i + 1 for the bound itself."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, b) for k, b in bounds.items()], "key string, bounds array<double>")
    below = F.size(F.filter("bounds", lambda b: b < F.col("v")))
    equal = F.coalesce(F.try_element_at("bounds", below + 1) == F.col("v"), F.lit(False)).cast("int")
    return rows.join(F.broadcast(table), F.col("k").eqNullSafe(F.col("key"))).select("k", "v", (2 * below + equal).alias("cell"))


def quantiles(df: DataFrame, value: str, probabilities: list[float], key: str | None = None) -> dict:
    """{group: [quantiles]}, interpolated between neighbours as ``percentile`` does; without ``key`` the group is ''.

    Nulls and NaN don't count; groups without values are left out. Group keys are told as strings, null as None. Groups
    times probabilities are few: their bounds are broadcast, and for each at most MAX_ROWS values reach the driver.
    """
    rows = _rows(df, value, key)
    margin = 2 / ACCURACY
    probes = sorted({min(1.0, max(0.0, p + d)) for p in probabilities for d in (-margin, margin)})
    first = rows.groupBy("k").agg(F.count("*").alias("n"), F.percentile_approx("v", probes, ACCURACY).alias("q"), F.min("v").alias("low"), F.max("v").alias("high"))
    sizes, bounds = {}, {}
    for r in first.collect():
        sizes[r["k"]], bounds[r["k"]] = r["n"], sorted({*r["q"], r["low"], r["high"]})
    wanted = {k: sorted({f(p * (n - 1)) for p in probabilities for f in (math.floor, math.ceil)}) for k, n in sizes.items()}
    found: dict = {}
    while any(r not in found.get(k, {}) for k, ranks in wanted.items() for r in ranks):
        open_groups = {k: bounds[k] for k, ranks in wanted.items() if any(r not in found.get(k, {}) for r in ranks)}
        counts: dict = {}
        for r in _placed(rows, open_groups).groupBy("k", "cell").agg(F.count("*").alias("n")).collect():
            counts.setdefault(r["k"], {})[r["cell"]] = r["n"]
        small, large = {}, {}
        for k in open_groups:
            before, starts, cells = 0, [], sorted(counts[k])
            for c in cells:
                starts.append(before)
                before += counts[k][c]
            for rank in wanted[k]:
                if rank in found.get(k, {}):
                    continue
                at = bisect_right(starts, rank) - 1
                cell, inside = cells[at], rank - starts[at]
                if cell % 2:
                    found.setdefault(k, {})[rank] = bounds[k][cell // 2]
                elif counts[k][cell] <= MAX_ROWS:
                    small.setdefault((k, cell), []).append((rank, inside))
                else:
                    large.setdefault((k, cell), []).append(inside / counts[k][cell])
        if small:
            _look(rows, open_groups, small, found)
        if large:
            _nearer(rows, open_groups, large, bounds)
    out = {}
    for k, n in sizes.items():
        values = []
        for p in probabilities:
            low, high = (found[k][f(p * (n - 1))] for f in (math.floor, math.ceil))
            share = p * (n - 1) - math.floor(p * (n - 1))
            values.append(low + (high - low) * share if share and math.isfinite(low) and math.isfinite(high) else low * (1 - share) + high * share if share else low)
        out[k] = values
    return out


def _chosen(rows: DataFrame, bounds: dict, cells: dict) -> DataFrame:
    """The rows in the given (group, cell) gaps."""
    some: dict = {}
    for k, c in cells:
        some.setdefault(k, []).append(c)
    table = rows.sparkSession.createDataFrame(list(some.items()), "chosen string, cells array<int>")
    placed = _placed(rows, {k: bounds[k] for k in some}).join(F.broadcast(table), F.col("k").eqNullSafe(F.col("chosen")))
    return placed.where(F.array_contains("cells", F.col("cell"))).select("k", "v", "cell")


def _look(rows: DataFrame, bounds: dict, cells: dict, found: dict) -> None:
    """Answers ranks in gaps of few rows by the values there."""
    values: dict = {}
    for r in _chosen(rows, bounds, cells).groupBy("k", "cell", "v").agg(F.count("*").alias("n")).collect():
        values.setdefault((r["k"], r["cell"]), []).append((r["v"], r["n"]))
    for (k, cell), ranks in cells.items():
        ordered, ends = sorted(values[k, cell]), []
        for _, n in ordered:
            ends.append(n + (ends[-1] if ends else 0))
        for rank, inside in ranks:
            found.setdefault(k, {})[rank] = ordered[bisect_left(ends, inside + 1)][0]


def _nearer(rows: DataFrame, bounds: dict, cells: dict, all_bounds: dict) -> None:
    """Adds bounds inside gaps of many rows, around the ranks that they hold."""
    margin = 2 / ACCURACY
    probes = sorted({min(1.0, max(0.0, p + d)) for shares in cells.values() for p in shares for d in (-margin, margin)})
    for r in _chosen(rows, bounds, cells).groupBy("k", "cell").agg(F.percentile_approx("v", probes, ACCURACY).alias("q")).collect():
        all_bounds[r["k"]] = sorted({*all_bounds[r["k"]], *r["q"]})
