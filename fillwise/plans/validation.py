"""Validation of boosted trees under every kind of fold, and the comparisons that rest on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillwise.functions import scalar as X
from fillwise.operators import boost, daily, folds, grid, linear, metrics, reports, scenarios
from fillwise.plans import grids
from fillwise.plans.fixtures import fixture, with_fixtures
from fillwise.plans.models import FEATURES, rows
from fillwise.plans.registry import register
from fillwise.plans.series import _OOF
from fillwise.plans.station_days import days
from fillwise.scratch import stored

#: Trees of the registered queries; the operators take any number.
SMALL = {"trees": 4, "depth": 2}
#: Offsets of the sample weight that are compared; None is no weight.
WEIGHT_OFFSETS = [None, 0.1, 0.25, 0.5, 1.0, 2.0]
#: What stands in for proxies among the features of the long series.
PROXIES = ["x1", "x2", "x3"]


def long(out: DataFrame, methods: list[str], *keep: str) -> DataFrame:
    return folds.long_predictions(out, methods, ["station_id", *keep])


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def boosted_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-block predictions by one split on one feature, all blocks at once: what SQL can state of boosting."""
    out = boost.boosted_oof(stored(rows(spark, sf_dir), "rows"), ["level"], "block", directions={}, trees=1, depth=1)
    return metrics.rounded(out.select("station_id", F.col("datum").cast("string").alias("datum"), "block", "boosted"))


register("boosted_stumps", boosted_stumps, with_fixtures("fx_series", _OOF + """,
r AS (SELECT station_id, datum, block, station_id % 7 AS v, ln(1 + bap) AS y, 1 / (bap + 0.5) AS w FROM b),
h AS (SELECT block, v, sum(w) AS w, sum(w * y) AS wy FROM r GROUP BY block, v),
t AS (SELECT v, sum(w) AS w, sum(wy) AS wy FROM h GROUP BY v),
m AS (SELECT k.block, t.v, t.w - coalesce(h.w, 0) AS w, t.wy - coalesce(h.wy, 0) AS wy
  FROM (SELECT DISTINCT block FROM r) k CROSS JOIN t LEFT JOIN h ON h.block = k.block AND h.v = t.v),
a AS (SELECT block, sum(wy) / sum(w) AS base FROM m GROUP BY block),
c AS (SELECT m.block, k.c, min(base) AS base, sum(wy - base * w) FILTER (v <= c) AS gl, sum(w) FILTER (v <= c) AS hl,
    sum(wy - base * w) FILTER (v > c) AS gr, sum(w) FILTER (v > c) AS hr
  FROM m JOIN a ON m.block = a.block, (VALUES (0), (1), (2), (3), (4), (5)) k(c) GROUP BY m.block, k.c),
s AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY gl * gl / (hl + 1.2) + gr * gr / (hr + 1.2) DESC, c) AS place FROM c)
SELECT station_id, CAST(datum AS VARCHAR) AS datum, r.block,
  round(greatest(0, exp(base + 0.3 * CASE WHEN v <= c THEN gl / (hl + 1.2) ELSE gr / (hr + 1.2) END) - 1), 6) AS boosted
FROM r JOIN s ON r.block = s.block AND place = 1"""))


def boosted_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five random folds: metrics of boosted trees by fold."""
    dealt = stored(folds.with_kfold(rows(spark, sf_dir), [F.col("station_id"), F.col("datum")]), "dealt")
    out = boost.boosted_oof(dealt, FEATURES, "fold", directions={"level": 1}, **SMALL)
    return metrics.rounded(metrics.metrics_by(out.select("fold", F.col("bap").alias("y"), F.col("boosted").alias("pred")), "fold"))


register("boosted_kfold", boosted_kfold)


def _stumps_sql(key: str, trees: int, rate: float = 0.3, l2: float = 1.2) -> str:
    """CTEs ``m0`` to ``m<trees>``: margins by (k, v) of stumps on v that leave each k out, from the sums of its rows.

    ``key`` is the expression of k; a column v, y and w of the rows ``b`` of _OOF. A row's margin depends on v only, so that
    sums by (k, v), total less own, carry every tree.
    """
    out = f"""r AS (SELECT *, {key} AS k, station_id % 7 AS v, ln(1 + bap) AS y, 1 / (bap + 0.5) AS w FROM b),
h AS (SELECT k, v, sum(w) AS w, sum(w * y) AS wy FROM r GROUP BY k, v),
tot AS (SELECT v, sum(w) AS w, sum(wy) AS wy FROM h GROUP BY v),
own AS (SELECT ks.k, tot.v, tot.w - coalesce(h.w, 0) AS w, tot.wy - coalesce(h.wy, 0) AS wy
  FROM (SELECT DISTINCT k FROM r) ks CROSS JOIN tot LEFT JOIN h ON h.k = ks.k AND h.v = tot.v),
m0 AS (SELECT k, v, w, wy, sum(wy) OVER (PARTITION BY k) / sum(w) OVER (PARTITION BY k) AS m FROM own)"""
    for t in range(1, trees + 1):
        out += f""",
c{t} AS (SELECT k, c, sum(wy - m * w) FILTER (v <= c) AS gl, sum(w) FILTER (v <= c) AS hl, sum(wy - m * w) FILTER (v > c) AS gr, sum(w) FILTER (v > c) AS hr
  FROM m{t - 1}, (VALUES (0), (1), (2), (3), (4), (5)) x(c) GROUP BY k, c),
s{t} AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(gl * gl / (hl + {l2}) + gr * gr / (hr + {l2}), 7) DESC, c) AS place FROM c{t}),
m{t} AS (SELECT m.k, v, w, wy, m + {rate} * CASE WHEN v <= c THEN gl / (hl + {l2}) ELSE gr / (hr + {l2}) END AS m FROM m{t - 1} m JOIN s{t} s ON m.k = s.k AND place = 1)"""
    return out


def boosted_loso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for each station by three stumps of all the others: every station is held out alone."""
    out = boost.boosted_oof(stored(rows(spark, sf_dir), "rows"), ["level"], "station_id", directions={}, trees=3, depth=1)
    return metrics.rounded(out.select("station_id", F.col("datum").cast("string").alias("datum"), "boosted"))


register("boosted_loso", boosted_loso, with_fixtures("fx_series", _OOF + ",\n" + _stumps_sql("station_id", 3) + """
SELECT station_id, CAST(datum AS VARCHAR) AS datum, round(greatest(0, exp(m) - 1), 6) AS boosted FROM r JOIN m3 ON r.k = m3.k AND r.v = m3.v"""))


def kfold_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by fold of two stumps, under five folds that a rule deals."""
    fold = F.pmod(F.col("station_id") * 31 + F.dayofyear("datum"), F.lit(5)).cast("int")
    out = boost.boosted_oof(stored(rows(spark, sf_dir).withColumn("fold", fold), "rows"), ["level"], "fold", directions={}, trees=2, depth=1)
    return metrics.rounded(metrics.metrics_by(out.select("fold", F.col("bap").alias("y"), F.col("boosted").alias("pred")), "fold"))


register("kfold_stumps", kfold_stumps, with_fixtures("fx_series", _OOF + ",\n" + _stumps_sql("CAST((station_id * 31 + dayofyear(datum)) % 5 AS INT)", 2) + """,
scored AS (SELECT r.k, bap AS y, greatest(0, exp(m) - 1) AS p FROM r JOIN m2 ON r.k = m2.k AND r.v = m2.v)
SELECT k AS fold, count(*) AS n, round(pow(corr(y, p), 2), 6) AS r2, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae,
  round(avg(p - y), 6) + 0 AS mbe, round(avg(y), 6) AS obs_mean, round(avg(p), 6) AS pred_mean FROM scored GROUP BY k"""))


def stump_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the gains and number of splits of two stumps of all rows."""
    model = boost.fit_monotone(stored(rows(spark, sf_dir), "rows"), ["level"], directions={}, trees=2, depth=1)
    return metrics.rounded(spark.createDataFrame([(c, float(model.gains[c]), model.splits[c]) for c in model.gains], "feature string, gain double, splits int"), 4)


_GAIN = "gl * gl / (hl + 1.2) + gr * gr / (hr + 1.2) - (gl + gr) * (gl + gr) / (hl + hr + 1.2)"
register("stump_importance", stump_importance, with_fixtures("fx_series", _OOF + ",\n" + _stumps_sql("1", 2).replace(
    "tot.w - coalesce(h.w, 0) AS w, tot.wy - coalesce(h.wy, 0) AS wy", "tot.w, tot.wy") + f"""
SELECT 'level' AS feature, round(sum(g), 4) AS gain, CAST(count(*) AS INT) AS splits
FROM (SELECT {_GAIN} AS g FROM s1 WHERE place = 1 UNION ALL SELECT {_GAIN} FROM s2 WHERE place = 1)"""))


def stump_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the station level adds to each prediction of three stumps of all rows, with the mean that it is added to."""
    data = stored(rows(spark, sf_dir), "rows")
    model = boost.fit_monotone(data, ["level"], directions={}, trees=3, depth=1)
    out = model.contributions(model.predict(data)).select("station_id", F.col("datum").cast("string").alias("datum"), "pred", F.col("contributions")[0].alias("level"))
    return metrics.rounded(out.withColumn("expected", F.lit(model.expected())))


register("stump_contributions", stump_contributions, with_fixtures("fx_series", _OOF + ",\n" + _stumps_sql("1", 3).replace(
    "tot.w - coalesce(h.w, 0) AS w, tot.wy - coalesce(h.wy, 0) AS wy", "tot.w, tot.wy") + """,
e AS (SELECT sum(w * m) / sum(w) AS e FROM m3)
SELECT station_id, CAST(datum AS VARCHAR) AS datum, round(greatest(0, exp(m) - 1), 6) AS pred, round(m - e, 6) + 0 AS level, round(e, 6) AS expected
FROM r JOIN m3 ON r.v = m3.v, e"""))


def _held_out(data: DataFrame, fold: str, sets: dict[str, list[str]], **options) -> DataFrame:
    """Adds for each set of features the prediction of the models that leave the row's fold out; the rows are binned once."""
    table = boost.binned(data, list(dict.fromkeys(c for f in sets.values() for c in f)), fold)
    for name, features in sets.items():
        data = boost.predict_folds(data, boost.fit_binned(table, features, **{**SMALL, **options}), fold, name)
    return data


def boosted_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station held out alone: pooled metrics of boosted trees and their medians over stations."""
    out = _held_out(stored(rows(spark, sf_dir), "rows"), "station_id", {"boosted": FEATURES}, directions={"level": 1})
    return metrics.rounded(reports.summary(long(out, ["boosted"])))


register("boosted_stations", boosted_stations)


def boosted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 30-day block held out alone: boosted trees, climatology and persistence on the same rows, pooled and by station."""
    out = _held_out(stored(rows(spark, sf_dir), "rows"), "block", {"boosted": FEATURES}, directions={"level": 1})
    both = folds.block_baselines(out.select("station_id", "datum", "bap", "boosted")).where("station_id IS NOT NULL")
    both = stored(both.select("station_id", "bap", "boosted", "clim", "persist"), "blocks")
    return metrics.rounded(reports.summary(long(both, ["boosted", "clim", "persist"])))


register("boosted_blocks", boosted_blocks)


def _versus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-block predictions of boosted trees and ridge under the same folds, with all features and without proxies."""
    data, free = stored(rows(spark, sf_dir), "rows"), [c for c in FEATURES if c not in PROXIES]
    out = _held_out(data, "block", {"boosted": FEATURES, "boosted_free": free}, directions={"level": 1})
    out = linear.ridge_oof(linear.ridge_oof(out, FEATURES, "block"), free, "block", name="ridge_free")
    return stored(out.select("station_id", "bap", "boosted", "ridge", "boosted_free", "ridge_free"), "versus")


METHODS = ["boosted", "ridge", "boosted_free", "ridge_free"]


def boosted_versus_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the four configurations on all rows and by observed level, and their medians over stations."""
    predictions = long(_versus(spark, sf_dir), METHODS)
    bands = metrics.metrics_by(reports.with_bands(predictions), "method", "band")
    medians = metrics.median_metrics(metrics.metrics_by(predictions, "method", "station_id"), "method").withColumn("band", F.lit("station median"))
    return metrics.rounded(bands.unionByName(medians))


register("boosted_versus_ridge", boosted_versus_ridge)


def boosted_ridge_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r2 of the four configurations by station, and how far boosted trees are ahead of ridge."""
    by_station = metrics.metrics_by(long(_versus(spark, sf_dir), METHODS), "method", "station_id")
    wide = by_station.groupBy("station_id").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("method") == m, F.col("r2"))).alias(m) for m in METHODS])
    return metrics.rounded(wide.withColumns({"ahead": F.col("boosted") - F.col("ridge"), "ahead_free": F.col("boosted_free") - F.col("ridge_free")}))


register("boosted_ridge_stations", boosted_ridge_stations)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed station-days with all features that the stand-in tables have, under their own names."""
    return with_typology(spark, sf_dir, daily.training_view(days(spark, sf_dir), fixture(spark, sf_dir, "fx_obs")))


def with_typology(spark: SparkSession, sf_dir: str, table: DataFrame) -> DataFrame:
    """Adds area and source types in codes, and the altitude."""
    stations = fixture(spark, sf_dir, "fx_station").select("station_id", X.area_code("typ_oblasti").alias("typ_oblasti_code"), "typ_zdroja", "altitude")
    out = table.join(stations, "station_id")
    return reports.encode(out, reports.category_codes(out, "typ_zdroja"), "typ_zdroja")


def full_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table with the layers of the stations' cells and what the day's wind carries: every feature of the study."""
    sites = grid.sampled(grids.station_cells(spark, sf_dir), grids.layers(spark, sf_dir)).drop(*grid.CELL)
    blown = grids.with_wind(spark, sf_dir, daily.daily_features(fixture(spark, sf_dir, "fx_hourly").drop("datum")))
    table = daily.observed_days(blown, fixture(spark, sf_dir, "fx_proxy_hourly").drop("datum"), fixture(spark, sf_dir, "fx_obs"))
    return stored(with_typology(spark, sf_dir, stored(table, "observed")).join(sites, "station_id", "left"), "features")


def ablation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M0 to M5, V, and M4 without constraints: boosted trees under random folds and with each station left out alone."""
    data = stored(folds.with_kfold(full_table(spark, sf_dir), [F.col("station_id"), F.col("datum")]), "ladder")
    sets = scenarios.ladder(data.columns)
    parts = []
    for scheme, fold in (("kfold", "fold"), ("stations", "station_id")):
        out = _held_out(data, fold, sets, trees=2)
        free = _held_out(data, fold, {"M4 unconstrained": sets["M4"]}, trees=2, directions={})
        for frame, names in ((out, list(sets)), (free, ["M4 unconstrained"])):
            parts.append(long(frame, names).withColumnRenamed("method", "model").withColumn("scheme", F.lit(scheme)))
    predictions = union(parts)
    pooled = metrics.metrics_by(predictions, "model", "scheme")
    by_station = metrics.metrics_by(predictions.where("scheme = 'stations'"), "model", "station_id")
    medians = metrics.median_metrics(by_station, "model").withColumn("scheme", F.lit("station median"))
    size = F.create_map(*[F.lit(x) for name, f in (*sets.items(), ("M4 unconstrained", sets["M4"])) for x in (name, len(f))])
    out = pooled.unionByName(medians).withColumn("n_features", size[F.col("model")])
    return metrics.rounded(out.select("model", "n_features", "scheme", "n", "r2", "rmse"))


register("ablation_ladder", ablation_ladder)


def _with_types(spark: SparkSession, sf_dir: str, out: DataFrame) -> DataFrame:
    types = fixture(spark, sf_dir, "fx_station").select("station_id", "typ_oblasti", "typ_zdroja")
    return out.drop("typ_oblasti", "typ_zdroja").join(types, "station_id")


def emission_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station left out, with and without proxies and emission: median skill, and the bias at rural stations."""
    data = full_table(spark, sf_dir)
    rung = scenarios.ladder(data.columns)
    free = scenarios.proxy_free(rung["M2"])
    emission = [c for c in rung["M4"] if c not in rung["M3"]]
    sets = {"proxy": rung["M3"], "proxy+emission": rung["M4"], "proxy-free": free, "proxy-free+emission": free + emission}
    out = long(_held_out(data, "station_id", sets), list(sets)).withColumnRenamed("method", "config")
    by_station = _with_types(spark, sf_dir, metrics.metrics_by(out, "config", "station_id"))
    rural = F.col("typ_oblasti") == "R"
    return metrics.rounded(by_station.groupBy("config").agg(
        F.median("r2").alias("median_r2"), F.avg(F.when(rural, F.abs("mbe"))).alias("rural_mean_abs_mbe"), F.median(F.when(rural, F.col("r2"))).alias("rural_median_r2")
    ))


register("emission_focus", emission_focus)


def boosted_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees by the offset of the sample weight, none too: random folds and each station left out, with the bias at rural stations."""
    data = stored(folds.with_kfold(full_table(spark, sf_dir), [F.col("station_id"), F.col("datum")]), "weights")
    features, parts = scenarios.ladder(data.columns)["M4"], []
    for scheme, fold in (("kfold", "fold"), ("stations", "station_id")):
        for offset in WEIGHT_OFFSETS:
            models = boost.fit_binned(boost.binned(data, features, fold, offset=offset), trees=2, depth=2)
            out = boost.predict_folds(data, models, fold)
            parts.append(out.select("station_id", F.lit(scheme).alias("scheme"), F.lit("none" if offset is None else str(offset)).alias("offset"), F.col("bap").alias("y"), "pred"))
    predictions = stored(union(parts), "weighted")
    by_station = _with_types(spark, sf_dir, metrics.metrics_by(predictions, "scheme", "offset", "station_id"))
    medians = by_station.groupBy("scheme", "offset").agg(
        F.median("r2").alias("median_r2"), F.avg(F.when(F.col("typ_oblasti") == "R", F.abs("mbe"))).alias("rural_mean_abs_mbe")
    )
    pooled = metrics.metrics_by(predictions, "scheme", "offset").select("scheme", "offset", "n", "r2", "rmse", "mae")
    return metrics.rounded(pooled.join(medians, ["scheme", "offset"]))


register("boosted_weights", boosted_weights)


def rural_yearly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly means at rural background stations: observed, by the model of all rows, without the station, and without proxies too.

    At stations without observations both models of all rows tell every day; there is nothing to leave out.
    """
    data = full_table(spark, sf_dir)
    m4, v = (scenarios.ladder(data.columns)[name] for name in ("M4", "V"))
    out = _held_out(data, "station_id", {"loso": m4, "v": v})
    for name, features in (("production", m4), ("v_all", v)):
        out = boost.fit_monotone(data, features, **SMALL).predict(out, name)
    out = _with_types(spark, sf_dir, out).where("typ_oblasti = 'R' AND typ_zdroja = 'B'")
    return metrics.rounded(out.groupBy("station_id", F.year("datum").alias("year")).agg(
        F.count("bap").alias("n_obs"), F.avg("bap").alias("obs_ym"), F.avg("production").alias("prod_ym"),
        F.avg(F.col("production") - F.col("bap")).alias("prod_mbe"), F.avg("loso").alias("loso_ym"), F.avg("v").alias("v_ym"), F.avg("v_all").alias("v_all_ym"),
    ))


register("rural_yearly_means", rural_yearly_means)


def boosted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of a split on average, number of splits and share of all gain by feature, with the feature's label; and sums by label."""
    data = full_table(spark, sf_dir)
    model = boost.fit_monotone(data, scenarios.ladder(data.columns)["M4"], trees=3, depth=3)
    shares = boost.gain_shares(model)
    found = [(c, scenarios.label_of(c), model.gains.get(c, 0.0) / model.splits.get(c, 1), model.splits.get(c, 0), v) for c, v in shares.items()]
    table = spark.createDataFrame(found, "feature string, grp string, gain double, splits int, share double")
    sums = table.groupBy("grp").agg(F.sum("gain").alias("gain"), F.sum("splits").cast("int").alias("splits"), F.sum("share").alias("share"))
    return metrics.rounded(table.unionByName(sums.withColumn("feature", F.lit(None).cast("string"))))


register("boosted_importance", boosted_importance)


def _contributions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The full table with the contributions of the model of all rows, wind too."""
    data = full_table(spark, sf_dir)
    features = scenarios.resolve(data.columns, "base", "derived", "spatial", "lags", "emission", "directional")
    return boost.fit_monotone(data, features, trees=4, depth=3).contributions(data), features


def boosted_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute contribution of each feature to ln(1 + bap), ranked, with the feature's label."""
    data, features = _contributions(spark, sf_dir)
    sums = data.agg(*[F.avg(F.abs(F.col("contributions")[k])).alias(c) for k, c in enumerate(features)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(scenarios.label_of(c)).alias("grp"), F.round(c, 6).alias("mean_abs")) for c in features])
    out = sums.select(F.inline(pairs))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")))


register("boosted_attribution", boosted_attribution)


def attribution_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of each driver and of its contribution in 20 quantile bins of the driver."""
    data, features = _contributions(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), F.col("contributions")[features.index(c)].alias("s")) for c in scenarios.DRIVERS])
    return metrics.rounded(reports.quantile_trends(stored(data.select(F.inline(pairs)), "drivers"), "feature", "x", "s", 20))


register("attribution_trends", attribution_trends)


def unseen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of all stations in the codes of those that are not rural: labels that training did not have are -1."""
    stations = fixture(spark, sf_dir, "fx_station").withColumn("type", X.type_code("typ_oblasti", "typ_zdroja"))
    codes = reports.category_codes(stations.where("typ_oblasti <> 'R'"), "type")
    return reports.encode(stations, codes, "type").groupBy("type", "type_code").agg(F.count("*").alias("n"))


register("unseen_labels", unseen_labels, with_fixtures("fx_station", """,
t AS (SELECT typ_oblasti || typ_zdroja AS type, typ_oblasti <> 'R' AS seen FROM fx_station),
c AS (SELECT type, CAST(dense_rank() OVER (ORDER BY type) - 1 AS INT) AS type_code FROM (SELECT DISTINCT type FROM t WHERE seen))
SELECT t.type, coalesce(type_code, -1) AS type_code, count(*) AS n FROM t LEFT JOIN c ON t.type = c.type GROUP BY 1, 2"""))
