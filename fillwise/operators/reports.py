"""Result tables: summaries, rosters, networks, rankings, bands, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillwise.functions import scalar as X
from fillwise.operators import metrics as M
from fillwise.operators.quantiles import quantiles


def summary(long: DataFrame) -> DataFrame:
    """Pooled metrics and station medians of each method. Both come from one pass over per-station rows."""
    pooled = M.metrics_by(long, "method").withColumn("scope", F.lit("pooled"))
    medians = M.median_metrics(M.metrics_by(long, "method", "station_id"), "method").withColumn("scope", F.lit("station median"))
    return pooled.unionByName(medians)


def by_type(long: DataFrame, *keys: str) -> DataFrame:
    out = long.groupBy("method", *keys).agg(*M.metric_columns(), F.count_distinct("station_id").alias("n_stations"))
    w = Window.partitionBy("method")

    def z(c: str):
        return F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w))

    return out.withColumns({"rmse_z": z("rmse"), "r2_z": z("r2")})


def method_matrix(table: DataFrame, methods: list[str]) -> DataFrame:
    cells = [F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{c}") for m in methods for c in ("r2", "rmse")]
    return table.groupBy("scope").agg(*cells)


def evaluation(long: DataFrame) -> DataFrame:
    out = M.determination(long, "method", "station_id")
    w = Window.partitionBy("method")
    return out.withColumns({"mean_r2_det": F.avg("r2_det").over(w), "mean_bias_pct": F.avg("bias_pct").over(w)})


def with_bands(long: DataFrame) -> DataFrame:
    """A row for each band that the value lies in."""
    y = F.col("y")
    bands = F.array(F.lit("all"), F.when(y <= 1, "<=1"), F.when(y > 1, ">1"), F.when(y > 3, ">3"))
    return long.withColumn("band", F.explode(F.filter(bands, lambda b: b.isNotNull())))


def deltas(by_station: DataFrame, a: str, b: str) -> DataFrame:
    wide = by_station.groupBy("station_id").agg(
        F.max(F.when(F.col("method") == a, F.col("rmse"))).alias(f"{a}_rmse"),
        F.max(F.when(F.col("method") == b, F.col("rmse"))).alias(f"{b}_rmse"),
    )
    wide = wide.withColumn("delta", F.col(f"{a}_rmse") - F.col(f"{b}_rmse"))
    return wide.withColumn("place", F.row_number().over(Window.orderBy("delta", "station_id")))


def on_every_day(stations: DataFrame, rows: DataFrame, days: DataFrame, values: list[str]) -> DataFrame:
    """The columns of ``stations``, __k and ``values``: each station's rows, and one of nulls for each day without a row.

    ``rows`` has station_id, __k and the values, ``days`` one row with __ks, all numbers of days. A station's rows are one
    array that meets the station once; the days are laid out after that, so no shuffle carries a row for each of them.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ["__k", *values]}
    lists = rows.groupBy("station_id").agg(F.collect_list(F.struct("__k", *values)).alias("__rows"))
    struct = "array<struct<" + ",".join(f"{c}:{t}" for c, t in kinds.items()) + ">>"
    met = stations.repartition(int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions")), "station_id").join(lists, "station_id", "left")
    met = met.withColumn("__rows", F.coalesce("__rows", F.array().cast(struct))).crossJoin(F.broadcast(days.select("__ks")))
    free = F.arrays_zip(F.array_except("__ks", F.col("__rows")["__k"]).alias("__k"), *[F.array().cast(f"array<{kinds[v]}>").alias(v) for v in values])
    return met.select(*stations.columns, F.inline(F.concat("__rows", free.cast(struct))))


def numbered_days(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(datum, __k) of the days of a series, from 0, and one row of all of them as arrays __ks and __days: there are as many as days."""
    days = series.select("datum").distinct()
    days = days.withColumn("__k", F.row_number().over(Window.orderBy("datum")) - 1)
    arrays = days.agg(F.array_sort(F.collect_list(F.struct("__k", "datum"))).alias("a"))
    return days, arrays.select(F.col("a")["__k"].alias("__ks"), F.col("a")["datum"].alias("__days"))


def fill_with_climatology(series: DataFrame, stations: DataFrame, digits: int | None = None) -> DataFrame:
    """Every (station, date): stations drive the plan, so sites without observations are filled too.

    Means are arrays by month at the station; the days come from the data and are laid out last (see on_every_day).
    With ``digits`` observations and means are rounded where they are one row each.
    """
    nice = lambda c: c if digits is None else F.round(c, digits) + F.lit(0.0)
    by_month = lambda value: F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.try_element_at(F.map_from_entries(F.collect_list(F.struct("month", value))), m))
    days, arrays = numbered_days(series)
    rows = series.join(F.broadcast(days), "datum").select("station_id", "__k", nice(F.col("bap")).alias("bap"))
    sums = series.groupBy("station_id", F.month("datum").alias("month")).agg(F.sum("bap").alias("s"), F.count("bap").alias("n"))
    mean = F.try_divide("s", "n")
    own = sums.groupBy("station_id").agg(by_month(nice(mean)).alias("__m"), nice(F.try_divide(F.sum("s"), F.sum("n"))).alias("__s"))
    overall = sums.groupBy("month").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(by_month(nice(mean)).alias("__g"))
    arrays = arrays.withColumn("__months", F.transform("__days", lambda d: F.month(d)))
    out = on_every_day(stations.select("station_id").join(own, "station_id", "left"), rows, arrays, ["bap"])
    out = out.crossJoin(F.broadcast(arrays.crossJoin(overall)))
    month = F.get("__months", F.col("__k")) - 1
    predicted = F.coalesce(F.get("__m", month), "__s", F.get("__g", month))
    return out.select(
        "station_id", F.get("__days", F.col("__k")).alias("datum"), "bap", predicted.alias("bap_predicted"), F.coalesce("bap", predicted).alias("bap_filled"),
        F.col("bap").isNotNull().cast("int").alias("is_observed"),
    )


def roster(oof: DataFrame, stations: DataFrame, proxies: DataFrame, year: int, since: str) -> DataFrame:
    yearly = oof.where(F.year("datum") == year).groupBy("station_id").agg(
        F.avg("bap").alias("obs_ym"), F.avg("clim").alias("model_ym"), F.count("bap").alias("n_obs"), F.avg(F.col("clim") - F.col("bap")).alias("bias")
    )
    monitored = oof.where(F.col("datum") >= F.lit(since).cast("date")).select("station_id").distinct().withColumn("__m", F.lit(True))
    tags = proxies.groupBy("station_id").agg(
        F.bool_or(F.col("pollutant").isin("pm10", "pm25")).alias("__pm"), F.bool_or(F.col("pollutant") == "no2").alias("__no2")
    )
    out = yearly.join(stations, "station_id").join(monitored, "station_id", "left").join(tags, "station_id", "left")
    order = F.when(F.col("typ_oblasti") == "U", 1).when(F.col("typ_oblasti") == "S", 2).otherwise(3)
    place = F.row_number().over(Window.orderBy(order, F.desc("model_ym"), "station_id"))
    return out.select(
        "station_id", "obs_ym", "model_ym", "n_obs", "bias", X.type_code("typ_oblasti", "typ_zdroja").alias("type"),
        F.when(F.col("__m"), "M").otherwise("V").alias("mv"), X.exceeds("model_ym").alias("exceeds"),
        X.proxy_tag(F.coalesce("__pm", F.lit(False)), F.coalesce("__no2", F.lit(False))).alias("proxies"), place.alias("place"),
    )


def network(series: DataFrame) -> DataFrame:
    yearly = series.groupBy(F.year("datum").alias("year"), "station_id").agg(
        F.avg("bap").alias("ym"), F.count("bap").alias("n"), F.min("datum").alias("first_day"), F.max("datum").alias("last_day")
    )
    days = F.datediff(F.max("last_day"), F.min("first_day")) + 1
    return yearly.groupBy("year").agg(
        F.count("*").alias("n_stations"), F.count_if(X.exceeds("ym")).alias("n_exceeding"), F.sum("n").alias("n_obs"),
        F.avg("ym").alias("mean_ym"), (100 * F.sum("n") / (F.count("*") * days)).alias("coverage_pct"),
    )


def profile(series: DataFrame) -> DataFrame:
    r = F.try_divide(F.covar_pop("x1", "bap"), F.stddev_pop("x1") * F.stddev_pop("bap"))
    return series.agg(
        F.count("*").alias("n"), F.count_distinct("station_id").alias("n_stations"), F.min("datum").alias("first_day"),
        F.max("datum").alias("last_day"), F.avg(X.sample_weight("bap")).alias("mean_weight"), r.alias("r_x1_bap"),
        F.max(X.log1p("bap")).alias("max_log"),
    )


def quantile_trends(long: DataFrame, key: str, x: str, y: str, bins: int) -> DataFrame:
    """(key, bin, n, x_median, y_median) of each group: right-closed bins between distinct exact quantiles of its x.

    The groups are few, and so are the numbers that reach the driver: edges and medians.
    """
    spark, group = long.sparkSession, F.col(key).cast("string")
    rows = long.where(F.col(x).isNotNull() & ~F.isnan(x) & F.col(key).isNotNull()).select(group.alias("g"), F.col(x).alias("x"), F.col(y).alias("y"))
    edges = {g: sorted(set(e)) for g, e in quantiles(rows, "x", [i / bins for i in range(bins + 1)], "g").items()}
    table = spark.createDataFrame(list(edges.items()), "of string, edges array<double>")
    dealt = rows.join(F.broadcast(table), F.col("g") == F.col("of"))
    dealt = dealt.withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda v: v < F.col("x")))))
    dealt = dealt.select("g", "bin", "x", "y", F.concat_ws("/", "bin", "g").alias("cell"))
    sizes = dealt.groupBy("g", "bin", "cell").agg(F.count("*").alias("n")).collect()
    xs, ys = (quantiles(dealt, c, [0.5], "cell") for c in ("x", "y"))
    out = [(r["g"], r["bin"], r["n"], xs[r["cell"]][0], ys.get(r["cell"], [None])[0]) for r in sizes]
    return spark.createDataFrame(out, f"`{key}` string, bin int, n long, x_median double, y_median double")


def quantile_trend(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """quantile_trends of one group."""
    return quantile_trends(df.withColumn("__all", F.lit("")), "__all", x, y, bins).drop("__all")


def category_codes(training: DataFrame, label: str) -> DataFrame:
    """(label, code): ranks of the distinct trimmed labels of the training rows, from 0."""
    labels = training.select(F.trim(label).alias(label)).where(F.col(label).isNotNull()).distinct()
    return labels.withColumn(f"{label}_code", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))


def encode(df: DataFrame, codes: DataFrame, label: str) -> DataFrame:
    """Adds the code; labels that training did not have are -1."""
    table = codes.select(F.col(label).alias("__label"), F.col(f"{label}_code").alias("__code"))
    out = df.join(table, F.trim(label) == F.col("__label"), "left")
    return out.withColumn(f"{label}_code", F.coalesce("__code", F.lit(-1))).drop("__label", "__code")
