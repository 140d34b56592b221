"""Readers and writers: explicit schemas, keys from file names, upserts, staged tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillwise.sources import pointers

# Fixed values of the formats: columns of station metadata and of verified observations.
STATION_META = T.StructType(
    [
        T.StructField("EOI", T.StringType()), T.StructField("NAME", T.StringType()), T.StructField("LAT", T.DoubleType()),
        T.StructField("LON", T.DoubleType()), T.StructField("LOC", T.StringType()), T.StructField("TYPE", T.StringType()),
        T.StructField("ALT", T.DoubleType()), T.StructField("II", T.IntegerType()),
    ]
)
VERIFIED_COLUMNS = ("Samplingpoint", "Start", "Value", "Validity", "Verification", "AggType")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is missing: aggregates skip null but not NaN."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def read_stations_meta(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated station metadata; keys are trimmed."""
    return spark.read.schema(STATION_META).option("header", True).option("sep", ";").csv(path).withColumn("EOI", F.trim("EOI"))


def with_metadata(stations: DataFrame, meta: DataFrame, key: str = "eoi", meta_key: str = "EOI", columns: tuple[str, ...] = ("II",)) -> DataFrame:
    """The stations that the metadata has, with its columns; the keys have different names and are trimmed."""
    rows = meta.select(F.trim(meta_key).alias("__key"), *columns)
    return stations.join(rows, F.trim(key) == F.col("__key")).drop("__key")


def clean_columns(df: DataFrame) -> DataFrame:
    """Column names without backslashes, as some exports have them."""
    return df.toDF(*[c.replace("\\", "") for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return nan_to_null(spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path))


def read_keyed_files(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str, key: str = "eoi") -> DataFrame:
    """One scan over many files; the key is the first group of ``pattern`` in the file's name."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)
    return nan_to_null(rows.withColumn(key, F.nullif(name, F.lit(""))))


def read_verified(spark: SparkSession, paths: list[str], columns: tuple[str, ...] = VERIFIED_COLUMNS) -> DataFrame:
    """The needed columns of verified observation files; the others are never read."""
    return spark.read.parquet(*paths).select(*columns)


def read_met_cube(cube: DataFrame, stations: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Hourly rows of the grid cell of each station. Stations are a dimension table; Spark broadcasts it when small."""
    return cube.join(stations.select("eoi", x, y), [x, y]).drop(x, y)


def chunked_cube(rows: DataFrame, keys: list[str], values: list[str], hours: int = 24, size: tuple[int, int] = (8, 8)) -> DataFrame:
    """Chunks of a grid (keys..., cy, cx, an array for each value) from long rows (keys..., h, y, x, values...).

    An array has the values of ``hours`` hours and size[0] by size[1] nodes, the hour first, then y, then x; what no row tells is null.
    """
    ny, nx = size
    at = ((F.col("h") * ny + F.pmod("y", F.lit(ny))) * nx + F.pmod("x", F.lit(nx))).cast("int")
    placed = rows.where(F.col("h").between(0, hours - 1)).select(
        *keys, F.floor(F.col("y") / ny).cast("int").alias("cy"), F.floor(F.col("x") / nx).cast("int").alias("cx"), at.alias("__at"), *values
    )
    places = F.sequence(F.lit(0), F.lit(hours * ny * nx - 1))
    found = placed.groupBy(*keys, "cy", "cx").agg(*[F.map_from_entries(F.collect_list(F.struct("__at", v))).alias(v) for v in values])

    def dense(v: str) -> Column:
        return F.transform(places, lambda k: F.try_element_at(v, k)).alias(v)

    return found.select(*keys, "cy", "cx", *map(dense, values))


def read_chunks(
    chunks: DataFrame, stations: DataFrame, values: list[str], hours: int = 24, size: tuple[int, int] = (8, 8), key: str = "eoi", x: str = "x", y: str = "y",
    base: str = "base", file_name: str = "file",
) -> DataFrame:
    """(key, time, values...) at the stations' nodes from chunked_cube: a node meets its chunks by an equi join and its values by index.

    Chunks are opened once for each node that has stations; the node's hours then meet its stations, however many. The time
    is the base date, or else the date in the file's name, plus the hour. Hours without any value are left out.
    """
    ny, nx = size
    nodes = stations.select(F.col(y).alias("__ny"), F.col(x).alias("__nx")).distinct()
    at_chunk = {"cy": F.floor(F.col("__ny") / ny).cast("int"), "cx": F.floor(F.col("__nx") / nx).cast("int"), "__y": F.pmod("__ny", F.lit(ny)), "__x": F.pmod("__nx", F.lit(nx))}
    met = chunks.join(nodes.withColumns(at_chunk), ["cy", "cx"])
    at = lambda h: ((h * ny + F.col("__y")) * nx + F.col("__x")).cast("int")
    series = F.transform(F.sequence(F.lit(0), F.lit(hours - 1)), lambda h: F.struct(h.alias("h"), *[F.get(F.col(v), at(h)).alias(v) for v in values]))
    rows = met.select("__ny", "__nx", base, file_name, F.inline(series)).where(F.coalesce(*[F.col(v).cast("string") for v in values]).isNotNull())
    timed = rows.select("__ny", "__nx", F.struct(hour_timestamp("h", base, file_name).alias("time"), *values).alias("__hour"))
    # a row for each node and file goes into the join; hours of one node and many files stay in arrays of their own
    hours_of = timed.groupBy("__ny", "__nx", F.to_date("__hour.time").alias("__day")).agg(F.collect_list("__hour").alias("__hours"))
    dealt = stations.repartition(int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    out = dealt.join(hours_of, (F.col(y) == F.col("__ny")) & (F.col(x) == F.col("__nx")))
    return out.select(key, F.inline("__hours"))


def select_years(df: DataFrame, years: list[int], column: str = "year") -> DataFrame:
    """On a table partitioned by year this prunes partitions."""
    return df.where(F.col(column).isin(*years))


def hour_timestamp(hour: Column | str, base: Column | str | None, file_name: Column | str | None = None) -> Column:
    """Base date plus hours; the base date is the attribute or else the yyyymmdd in the file's name."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    dates = [] if base is None else [col(base).cast("timestamp")]
    if file_name is not None:
        dates.append(F.try_to_timestamp(F.nullif(F.regexp_extract(col(file_name), r"(\d{8})", 1), F.lit("")), F.lit("yyyyMMdd")))
    return F.coalesce(*dates) + F.make_dt_interval(F.lit(0), col(hour))


def parse_observations(df: DataFrame, json: str = "body", key: str = "eoi") -> DataFrame:
    """(key, time, value) from lists of {timestamp, value}; null values and what is no list give nothing."""
    kind = "array<struct<timestamp:string,value:double>>"
    listed = df.where(F.ltrim(json).startswith("["))
    rows = listed.select(key, F.inline(F.from_json(json, kind)))
    return rows.where("value IS NOT NULL").select(key, F.col("timestamp").cast("timestamp").alias("time"), "value")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """All rows of both, the newest of each key: of ``new`` before ``old``, within one the largest ``order``.

    Rows that tie in that are ordered by their other columns, so that reruns agree.
    """
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in (*keys, order, "__batch")]
    last = [F.desc("__batch"), *([F.desc_nulls_last(order)] if order else []), *[F.desc_nulls_last(c) for c in others]]
    ranked = both.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*last)))
    return ranked.where("__rank = 1").drop("__rank", "__batch")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


@dataclass(frozen=True)
class Run:
    """Paths of one run's stages and results."""

    root: str
    name: str = "default"

    def stage(self, version: str) -> str:
        return f"{self.root}/runs/{self.name}/stages/{version}"

    def result(self, table: str) -> str:
        return f"{self.root}/runs/{self.name}/results/{table}"

    def publish(self, df: DataFrame, version: str) -> None:
        """Writes a stage's table to a folder of its own and then points to it; of older folders the last one stays for its readers.

        Until the pointer is in place nobody sees the new folder. What a killed run left goes with the next one.
        """
        spark, at = df.sparkSession, self.stage(version)
        done = self._published(spark, version)
        number = done[-1] + 1 if done else 0
        df.write.mode("overwrite").parquet(f"{at}/data-{number}")
        pointers.put(spark, f"{at}/live-{number}", f"data-{number}")
        for name in pointers.names(spark, at):
            if int(name.rpartition("-")[2]) < number - 1:
                pointers.remove(spark, f"{at}/{name}")

    def _published(self, spark: SparkSession, version: str) -> list[int]:
        names = pointers.names(spark, self.stage(version))
        return sorted(int(n.removeprefix("live-")) for n in names if n.removeprefix("live-").isdigit())

    def open(self, spark: SparkSession, version: str) -> DataFrame:
        """The live table of a stage."""
        done = self._published(spark, version)
        if not done:
            raise ValueError(f"stage {version} of run {self.name} is not published")
        at = self.stage(version)
        return spark.read.parquet(f"{at}/{pointers.read(spark, f'{at}/live-{done[-1]}')}")

    def extend(self, spark: SparkSession, version: str, newer: str, columns: DataFrame, keys: list[str]) -> None:
        """Publishes a stage made from another one: its rows with further columns where the keys have them."""
        self.publish(self.open(spark, version).join(columns, keys, "left"), newer)
