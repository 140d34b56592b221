"""Folds as columns, and the baselines that leave them out by sums rather than by a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DAYS, MIN_BLOCK_ROWS = 30, 3


def with_block(df: DataFrame, day: str = "datum", days: int = BLOCK_DAYS) -> DataFrame:
    """Number of the 30-day block since the first date of all rows (one row is broadcast)."""
    origin = df.agg(F.min(day).alias("__origin"))
    out = df.crossJoin(F.broadcast(origin))
    return out.withColumn("block", F.floor(F.datediff(day, "__origin") / days).cast("int")).drop("__origin")


def with_kfold(df: DataFrame, order: list[Column], k: int = 5, rows_each: int = 50_000) -> DataFrame:
    """k folds whose sizes differ by 1 at most, dealt in a fixed shuffled order.

    Rows are numbered within hash buckets of about ``rows_each`` rows; bucket sizes are summed on a few rows; so no task
    sorts the whole table.
    """
    buckets = max(1, -(-df.count() // rows_each))
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    number = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    out = rows.withColumn("__number", number).join(F.broadcast(starts), "__bucket")
    return out.withColumn("fold", ((F.col("__start") + F.col("__number")) % k).cast("int")).drop("__bucket", "__number", "__start")


def block_baselines(series: DataFrame, key: str = "station_id", day: str = "datum", y: str = "bap") -> DataFrame:
    """Adds block, clim and persist: predictions of each row from all rows outside its block.

    Climatology: the station's mean of the calendar month, else of the station, else of all. Persistence: the
    station's last value before the block, else the station's mean, else the mean of all. Leaving out is total minus
    part, with windows that all hang on the station, so one shuffle carries them. Blocks of under 3 rows are dropped.
    """
    df = with_block(series, day).withColumn("month", F.month(day))
    per_block = df.groupBy("block").agg(F.sum(y).alias("__bs"), F.count(y).alias("__bn"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_block = per_block.withColumns({"__gs": F.sum("__bs").over(everything), "__gn": F.sum("__bn").over(everything)})

    def part(*keys: str) -> tuple[Column, Column]:
        w = Window.partitionBy(key, *keys)
        return F.sum(y).over(w), F.count(y).over(w)

    (s, n), (sm, nm), (sb, nb), (smb, nmb) = part(), part("month"), part("block"), part("block", "month")
    df = df.withColumns(
        {
            "__month_mean": (sm - smb) / F.nullif(nm - nmb, F.lit(0)),
            "__station_mean": (s - sb) / F.nullif(n - nb, F.lit(0)),
        }
    )
    in_block = Window.partitionBy(key, "block").orderBy(day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_day = Window.partitionBy(key).orderBy(day)
    # the last value of the station's earlier rows that lie in another block
    df = df.withColumn("__first", F.first(day).over(in_block) == F.col(day))
    previous = F.when(F.col("__first"), F.lag(y).over(by_day))
    df = df.withColumn("__previous", previous)
    df = df.withColumn("__asof", F.first("__previous", ignorenulls=True).over(in_block))
    df = df.join(F.broadcast(per_block), "block").where(F.col("__bn") >= MIN_BLOCK_ROWS)
    overall = (F.col("__gs") - F.col("__bs")) / F.nullif(F.col("__gn") - F.col("__bn"), F.lit(0))
    out = df.withColumns(
        {
            "clim": F.coalesce("__month_mean", "__station_mean", overall),
            "persist": F.coalesce("__asof", "__station_mean", overall),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def long_predictions(oof: DataFrame, methods: list[str], keep: list[str], y: str = "bap") -> DataFrame:
    """(keep..., y, method, pred): one row for each method."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("pred")) for m in methods])
    return oof.select(*keep, F.col(y).alias("y"), F.inline(pairs))
