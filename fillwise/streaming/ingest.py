"""Streaming forms: upserts of arriving rows into a bucketed table, and daily aggregates with late rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fillwise.operators import daily
from fillwise.sources import pointers
from fillwise.sources.tables import upsert

BUCKETS = 64


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions."""
    return sorted(int(n.removeprefix("manifest-")) for n in pointers.names(spark, path) if re.fullmatch(r"manifest-\d+", n))


def live(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """{bucket: version} of the newest complete version, or of the newest before a number."""
    done = [n for n in manifests(spark, path) if before is None or n < before]
    return {int(b): v for b, v in json.loads(pointers.read(spark, f"{path}/manifest-{done[-1]}")).items()} if done else {}


def current(spark: SparkSession, path: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The table: the folders that its manifest names, no others are listed; None before the first version."""
    folders = [f"{path}/version={v}/bucket={b}" for b, v in live(spark, path, before).items() if buckets is None or b in buckets]
    return spark.read.option("basePath", path).parquet(*folders).drop("version") if folders else None


def upserts_into(path: str, keys: list[str], order: str | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: merges a batch into the table and writes the buckets that it touches, as a new version.

    Of a key's rows in one batch that with the largest ``order`` wins (ties go by the other columns), and a batch wins
    over what was there. A version is named by its batch and becomes live with its manifest, which is put in place at the
    end: a batch that was killed left nothing that anyone reads, and writes the same version when it runs again. Folders
    that neither the new manifest nor the one before it names are removed, so a reader of the version before goes on.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        newest = upsert(batch.limit(0), batch, keys, order)
        before = live(spark, path, number)
        touched = {r["bucket"] for r in batch.select("bucket").distinct().collect()}
        old = current(spark, path, number, touched)
        if old is not None:
            newest = upsert(old.select(batch.columns), newest, keys, order)
        newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
        pointers.put(spark, f"{path}/manifest-{number}", json.dumps({**before, **dict.fromkeys(sorted(touched), number)}))
        _clean(spark, path, number)

    return merge


def _clean(spark: SparkSession, path: str, number: int) -> None:
    """Removes manifests but the last two, and bucket folders that these do not name; versions after them are not touched."""
    kept = [n for n in manifests(spark, path) if n <= number][-2:]
    named = {f"version={v}/bucket={b}" for n in kept for b, v in json.loads(pointers.read(spark, f"{path}/manifest-{n}")).items()}
    gone = [f"manifest-{n}" for n in manifests(spark, path) if n < kept[0]]
    for version in (n for n in pointers.names(spark, path) if re.fullmatch(r"version=\d+", n) and int(n.removeprefix("version=")) <= number):
        folders = [f"{version}/{b}" for b in pointers.names(spark, f"{path}/{version}") if b.startswith("bucket=")]
        stale = [f for f in folders if f not in named]
        gone += [version] if len(stale) == len(folders) and int(version.removeprefix("version=")) < kept[-1] else stale
    for name in gone:
        pointers.remove(spark, f"{path}/{name}")


def stream_upserts(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str | None = None) -> StreamingQuery:
    """Each micro-batch is merged into the table under ``path``; the newest rows win. ``current`` reads it."""
    merge = upserts_into(path, keys, order)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_daily(stream: DataFrame, key: str = "station_id", time: str = "time", late: str = "2 days") -> DataFrame:
    """All daily features by tumbling windows, with the number of rows: the aggregates of the batch form.

    In update or append mode the state of a day is dropped once the watermark has passed it, and rows later than that
    are dropped too; ``dropped`` counts them.
    """
    h = daily.hourly_inputs(stream).withColumn("__time", F.col(time)).withWatermark("__time", late)
    days = h.groupBy(F.window("__time", "1 day").alias("w"), key).agg(F.count("*").alias("n"), *daily.daily_aggregates(daily.absent_columns(stream)))
    return daily.with_calendar(days.withColumn("datum", F.to_date(F.col("w.start"))).drop("w"))


def dropped(query: StreamingQuery) -> int:
    """How often the query left rows beyond the watermark out, as the state operators of its recent progress count it."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
