"""Queries over daily series: baselines under block folds, metrics, rosters, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.functions import scalar as X
from fillwise.operators import folds, metrics, reports
from fillwise.plans.fixtures import CLEAN_NAME, fixture, with_fixtures
from fillwise.plans.registry import register
from fillwise.scratch import stored

METHODS = ["clim", "persist"]

_OOF = """, o AS (SELECT min(datum) AS d0 FROM fx_series),
b AS (SELECT s.*, month(datum) AS month, CAST(floor(date_diff('day', d0, datum) / 30) AS INT) AS block FROM fx_series s, o),
bt AS (SELECT block, sum(bap) AS bs, count(bap) AS bn FROM b GROUP BY block),
g AS (SELECT sum(bap) AS gs, count(bap) AS gn FROM b),
lastv AS (SELECT station_id, block, max_by(bap, datum) AS last FROM b GROUP BY station_id, block),
prev AS (SELECT station_id, block, lag(last) OVER (PARTITION BY station_id ORDER BY block) AS asof_bap FROM lastv),
w AS (SELECT b.*,
  sum(bap) OVER (PARTITION BY station_id) AS s, count(bap) OVER (PARTITION BY station_id) AS n,
  sum(bap) OVER (PARTITION BY station_id, month) AS sm, count(bap) OVER (PARTITION BY station_id, month) AS nm,
  sum(bap) OVER (PARTITION BY station_id, block) AS sb, count(bap) OVER (PARTITION BY station_id, block) AS nb,
  sum(bap) OVER (PARTITION BY station_id, block, month) AS smb, count(bap) OVER (PARTITION BY station_id, block, month) AS nmb
  FROM b),
oof AS (SELECT w.station_id, w.datum, w.block, w.month, w.bap,
  coalesce((sm - smb) / nullif(nm - nmb, 0), (s - sb) / nullif(n - nb, 0), (gs - bs) / nullif(gn - bn, 0)) AS clim,
  coalesce(asof_bap, (s - sb) / nullif(n - nb, 0), (gs - bs) / nullif(gn - bn, 0)) AS persist
  FROM w JOIN bt ON w.block = bt.block JOIN prev ON w.station_id = prev.station_id AND w.block = prev.block, g WHERE bn >= 3),
p AS (SELECT station_id, datum, block, bap AS y, 'clim' AS method, clim AS pred FROM oof
  UNION ALL SELECT station_id, datum, block, bap, 'persist', persist FROM oof)
"""

_M = """count(*) AS n, CASE WHEN count(*) >= 2 THEN power(covar_pop(y, pred) / nullif(stddev_pop(y) * stddev_pop(pred), 0), 2) END AS r2,
  sqrt(avg((pred - y) * (pred - y))) AS rmse, avg(abs(pred - y)) AS mae, avg(pred - y) AS mbe, avg(y) AS obs_mean, avg(pred) AS pred_mean"""
_R = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.METRICS)
_MED = ", ".join(f"round(median({m}), 6) AS {m}" for m in metrics.METRICS)


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.block_baselines(fixture(spark, sf_dir, "fx_series"))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.long_predictions(oof(spark, sf_dir), METHODS, ["station_id", "datum", "block"])


def block_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rounded(oof(spark, sf_dir).select("station_id", F.col("datum").cast("string").alias("datum"), "block", "bap", "clim", "persist"))


register("block_predictions", block_predictions, with_fixtures("fx_series", _OOF + """
SELECT station_id, CAST(datum AS VARCHAR) AS datum, block, round(bap, 6) AS bap, round(clim, 6) AS clim, round(persist, 6) AS persist FROM oof"""))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rounded(reports.summary(long(spark, sf_dir)))


register("metric_summary", metric_summary, with_fixtures("fx_series", _OOF + f""",
st AS (SELECT method, station_id, {_M} FROM p GROUP BY method, station_id)
SELECT method, 'pooled' AS scope, n, {_R} FROM (SELECT method, {_M} FROM p GROUP BY method)
UNION ALL SELECT method, 'station median' AS scope, sum(n) AS n, {_MED} FROM st GROUP BY method"""))


def metrics_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = fixture(spark, sf_dir, "fx_station").select(
        "station_id", X.clean_name("name").alias("name"), X.type_code("typ_oblasti", "typ_zdroja").alias("type")
    )
    return metrics.rounded(metrics.metrics_by(long(spark, sf_dir), "method", "station_id").join(names, "station_id"))


register("metrics_by_station", metrics_by_station, with_fixtures("fx_series fx_station", _OOF + f""",
st AS (SELECT method, station_id, {_M} FROM p GROUP BY method, station_id)
SELECT st.station_id, method, n, {_R}, {CLEAN_NAME} AS name, typ_oblasti || typ_zdroja AS type
FROM st JOIN fx_station f ON st.station_id = f.station_id"""))


def metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, number of stations and z-scores of the metrics by (area, source)."""
    types = fixture(spark, sf_dir, "fx_station").select("station_id", "typ_oblasti", "typ_zdroja")
    return metrics.rounded(reports.by_type(long(spark, sf_dir).join(types, "station_id"), "typ_oblasti", "typ_zdroja"))


register("metrics_by_type", metrics_by_type, with_fixtures("fx_series fx_station", _OOF + f""",
t AS (SELECT method, typ_oblasti, typ_zdroja, {_M}, count(DISTINCT p.station_id) AS n_stations
  FROM p JOIN fx_station f ON p.station_id = f.station_id GROUP BY method, typ_oblasti, typ_zdroja)
SELECT method, typ_oblasti, typ_zdroja, n, {_R}, n_stations,
  round((rmse - avg(rmse) OVER (PARTITION BY method)) / nullif(stddev_pop(rmse) OVER (PARTITION BY method), 0), 6) AS rmse_z,
  round((r2 - avg(r2) OVER (PARTITION BY method)) / nullif(stddev_pop(r2) OVER (PARTITION BY method), 0), 6) AS r2_z
FROM t"""))


def metrics_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled, per block and per station in one pass."""
    sets = [["method"], ["method", "block"], ["method", "station_id"]]
    return metrics.rounded(metrics.metric_sets(long(spark, sf_dir), sets).drop("level"))


register("metrics_by_level", metrics_by_level, with_fixtures("fx_series", _OOF + f"""
SELECT method, block, station_id, n, {_R} FROM (
  SELECT method, block, station_id, {_M} FROM p GROUP BY GROUPING SETS ((method), (method, block), (method, station_id)))"""))


def baseline_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes as rows, methods side by side."""
    return metrics.rounded(reports.method_matrix(reports.summary(long(spark, sf_dir)), METHODS))


register("baseline_matrix", baseline_matrix, with_fixtures("fx_series", _OOF + f""",
st AS (SELECT method, station_id, {_M} FROM p GROUP BY method, station_id),
r AS (SELECT method, 'pooled' AS scope, r2, rmse FROM (SELECT method, {_M} FROM p GROUP BY method)
  UNION ALL SELECT method, 'station median', median(r2), median(rmse) FROM st GROUP BY method)
SELECT scope, round(max(r2) FILTER (method = 'clim'), 6) AS clim_r2, round(max(rmse) FILTER (method = 'clim'), 6) AS clim_rmse,
  round(max(r2) FILTER (method = 'persist'), 6) AS persist_r2, round(max(rmse) FILTER (method = 'persist'), 6) AS persist_rmse
FROM r GROUP BY scope"""))


def station_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient of determination and percent bias by station, best first, with the mean over stations."""
    return metrics.rounded(reports.evaluation(long(spark, sf_dir)))


register("station_evaluation", station_evaluation, with_fixtures("fx_series", _OOF + """,
e AS (SELECT method, station_id, count(*) AS n, 1 - sum(power(y - pred, 2)) / nullif(var_pop(y) * count(*), 0) AS r2_det,
  (avg(pred) - avg(y)) / nullif(avg(y), 0) * 100 AS bias_pct FROM p GROUP BY method, station_id HAVING count(*) >= 3)
SELECT method, station_id, n, round(r2_det, 6) AS r2_det, round(bias_pct, 6) AS bias_pct,
  round(avg(r2_det) OVER (PARTITION BY method), 6) AS mean_r2_det, round(avg(bias_pct) OVER (PARTITION BY method), 6) AS mean_bias_pct FROM e"""))


def band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics in overlapping bands of the observed value."""
    return metrics.rounded(metrics.metrics_by(reports.with_bands(long(spark, sf_dir)), "method", "band"))


register("band_metrics", band_metrics, with_fixtures("fx_series", _OOF + f""",
bands AS (SELECT p.*, unnest(list_filter(['all', CASE WHEN y <= 1 THEN '<=1' END, CASE WHEN y > 1 THEN '>1' END, CASE WHEN y > 3 THEN '>3' END],
  lambda x: x IS NOT NULL)) AS band FROM p)
SELECT method, band, n, {_R} FROM (SELECT method, band, {_M} FROM bands GROUP BY method, band)"""))


def method_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE of two methods by station and their difference, most improved first, ranked."""
    by_station = metrics.metrics_by(long(spark, sf_dir), "method", "station_id")
    return metrics.rounded(reports.deltas(by_station, "clim", "persist"))


register("method_deltas", method_deltas, with_fixtures("fx_series", _OOF + f""",
st AS (SELECT method, station_id, {_M} FROM p GROUP BY method, station_id),
d AS (SELECT a.station_id, a.rmse AS clim_rmse, b.rmse AS persist_rmse, a.rmse - b.rmse AS delta
  FROM st a JOIN st b ON a.station_id = b.station_id AND a.method = 'clim' AND b.method = 'persist')
SELECT station_id, round(clim_rmse, 6) AS clim_rmse, round(persist_rmse, 6) AS persist_rmse, round(delta, 6) AS delta,
  row_number() OVER (ORDER BY delta, station_id) AS place FROM d"""))


def filled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date of every station: the observation, or else the station's climatology; with coverage."""
    series = stored(fixture(spark, sf_dir, "fx_series").select("station_id", "datum", "bap"), "series")
    stations = fixture(spark, sf_dir, "fx_station").select("station_id")
    return reports.fill_with_climatology(series, stations, digits=6).withColumn("datum", F.col("datum").cast("string"))


register("filled_series", filled_series, with_fixtures("fx_series fx_station", """,
days AS (SELECT DISTINCT datum FROM fx_series),
st AS (SELECT station_id FROM fx_station),
m AS (SELECT station_id, month(datum) AS month, avg(bap) AS v FROM fx_series GROUP BY 1, 2),
s AS (SELECT station_id, avg(bap) AS v FROM fx_series GROUP BY 1),
g AS (SELECT month(datum) AS month, avg(bap) AS v FROM fx_series GROUP BY 1)
SELECT st.station_id, CAST(d.datum AS VARCHAR) AS datum, round(x.bap, 6) AS bap, round(coalesce(m.v, s.v, g.v), 6) AS bap_predicted,
  round(coalesce(x.bap, m.v, s.v, g.v), 6) AS bap_filled, CASE WHEN x.bap IS NULL THEN 0 ELSE 1 END AS is_observed
FROM st CROSS JOIN days d LEFT JOIN fx_series x ON x.station_id = st.station_id AND x.datum = d.datum
LEFT JOIN m ON m.station_id = st.station_id AND m.month = month(d.datum) LEFT JOIN s ON s.station_id = st.station_id
LEFT JOIN g ON g.month = month(d.datum)"""))


def station_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly means, days, bias against climatology, monitored flag, exceedance and place in the roster."""
    frame = oof(spark, sf_dir)
    stations = fixture(spark, sf_dir, "fx_station")
    proxies = fixture(spark, sf_dir, "fx_proxy_hourly")
    return metrics.rounded(reports.roster(frame, stations, proxies, year=1996, since="1996-06-01"))


register("station_roster", station_roster, with_fixtures("fx_series fx_station fx_proxy_hourly", _OOF + """,
y AS (SELECT station_id, avg(bap) AS obs_ym, avg(clim) AS model_ym, count(bap) AS n_obs, avg(clim - bap) AS bias FROM oof WHERE year(datum) = 1996 GROUP BY 1),
mon AS (SELECT DISTINCT station_id FROM oof WHERE datum >= DATE '1996-06-01'),
px AS (SELECT station_id, bool_or(pollutant IN ('pm10', 'pm25')) AS pm, bool_or(pollutant = 'no2') AS no2 FROM fx_proxy_hourly GROUP BY 1)
SELECT y.station_id, round(obs_ym, 6) AS obs_ym, round(model_ym, 6) AS model_ym, n_obs, round(bias, 6) AS bias,
  typ_oblasti || typ_zdroja AS type, CASE WHEN mon.station_id IS NULL THEN 'V' ELSE 'M' END AS mv, model_ym > 1.0 AS exceeds,
  coalesce(nullif(concat_ws('+', CASE WHEN pm THEN 'PM' END, CASE WHEN no2 THEN 'NO2' END), ''), 'none') AS proxies,
  row_number() OVER (ORDER BY CASE typ_oblasti WHEN 'U' THEN 1 WHEN 'S' THEN 2 ELSE 3 END, model_ym DESC, y.station_id) AS place
FROM y JOIN fx_station f ON y.station_id = f.station_id LEFT JOIN mon ON y.station_id = mon.station_id LEFT JOIN px ON y.station_id = px.station_id"""))


def network_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year: stations, stations above the target value, share observed, span of the data."""
    return metrics.rounded(reports.network(fixture(spark, sf_dir, "fx_series")))


register("network_table", network_table, with_fixtures("fx_series", """,
y AS (SELECT year(datum) AS year, station_id, avg(bap) AS ym, count(bap) AS n, min(datum) AS first_day, max(datum) AS last_day FROM fx_series GROUP BY 1, 2)
SELECT year, count(*) AS n_stations, count(*) FILTER (ym > 1.0) AS n_exceeding, sum(n) AS n_obs, round(avg(ym), 6) AS mean_ym,
  round(100 * sum(n) / (count(*) * (date_diff('day', min(first_day), max(last_day)) + 1)), 6) AS coverage_pct FROM y GROUP BY year"""))


def top_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stations with the highest means."""
    means = fixture(spark, sf_dir, "fx_series").groupBy("station_id").agg(F.round(F.avg("bap"), 6).alias("mean_bap"), F.count("bap").alias("n"))
    return means.orderBy(F.desc_nulls_last("mean_bap"), "station_id").limit(5)


register("top_stations", top_stations, with_fixtures("fx_series", """
SELECT station_id, round(avg(bap), 6) AS mean_bap, count(bap) AS n FROM fx_series GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))


def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, stations, span, weights and correlations of the training table."""
    profile = reports.profile(fixture(spark, sf_dir, "fx_series"))
    return metrics.rounded(profile.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")}))


register("dataset_profile", dataset_profile, with_fixtures("fx_series", """
SELECT count(*) AS n, count(DISTINCT station_id) AS n_stations, CAST(min(datum) AS VARCHAR) AS first_day, CAST(max(datum) AS VARCHAR) AS last_day,
  round(avg(1 / (bap + 0.5)), 6) AS mean_weight, round(corr(x1, bap), 6) AS r_x1_bap, round(max(ln(1 + bap)), 6) AS max_log
FROM fx_series"""))


def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each of five random folds; they differ by one at most."""
    dealt = folds.with_kfold(fixture(spark, sf_dir, "fx_series"), [F.col("station_id"), F.col("datum")])
    return dealt.groupBy("fold").agg(F.count("*").alias("n"))


register("fold_sizes", fold_sizes, with_fixtures("fx_series", """, n AS (SELECT count(*) AS n FROM fx_series)
SELECT CAST(k AS INT) AS fold, n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END AS n FROM n, range(5) t(k)"""))


def trend_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of x1 and bap in 20 quantile bins of x1."""
    return metrics.rounded(reports.quantile_trend(fixture(spark, sf_dir, "fx_series").withColumn("x1", F.round("x1", 6)), "x1", "bap", 20))


register("trend_bins", trend_bins, with_fixtures("fx_series", """,
x AS (SELECT round(x1, 6) AS x1, bap FROM fx_series),
e AS (SELECT list_sort(list_distinct(quantile_cont(x1, [i / 20.0 for i in range(0, 21)]))) AS edges FROM x),
b AS (SELECT x1, bap, greatest(1, len(list_filter(edges, lambda v: v < x1))) AS bin FROM x, e)
SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(median(x1), 6) AS x_median, round(median(bap), 6) AS y_median FROM b GROUP BY bin"""))


def type_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by type with the rank of each label, as the training categories have it."""
    stations = fixture(spark, sf_dir, "fx_station").withColumn("type", X.type_code("typ_oblasti", "typ_zdroja"))
    codes = reports.category_codes(stations, "type")
    joined = reports.encode(stations, codes, "type")
    return joined.groupBy("type", "type_code").agg(
        F.count("*").alias("n"), X.round_half_even(F.avg("altitude"), 3).alias("mean_altitude"), F.min(X.area_code("typ_oblasti")).alias("area_code")
    )


register("type_means", type_means, with_fixtures("fx_station", """,
t AS (SELECT *, typ_oblasti || typ_zdroja AS type FROM fx_station), c AS (SELECT type, CAST(dense_rank() OVER (ORDER BY type) - 1 AS INT) AS type_code FROM (SELECT DISTINCT type FROM t))
SELECT t.type, type_code, count(*) AS n, round_even(avg(altitude) * 1e3, 0) / 1e3 AS mean_altitude, min(CASE typ_oblasti WHEN 'S' THEN 1 WHEN 'U' THEN 2 ELSE 0 END) AS area_code
FROM t JOIN c ON t.type = c.type GROUP BY 1, 2"""))


def rural_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute bias over rural stations, by method."""
    rural = fixture(spark, sf_dir, "fx_station").where("typ_oblasti = 'R'").select("station_id")
    by_station = metrics.metrics_by(long(spark, sf_dir), "method", "station_id").join(rural, "station_id", "left_semi")
    return by_station.groupBy("method").agg(F.count("*").alias("n_stations"), F.round(F.avg(F.abs("mbe")), 6).alias("mean_abs_mbe"))


register("rural_bias", rural_bias, with_fixtures("fx_series fx_station", _OOF + f""",
st AS (SELECT method, station_id, {_M} FROM p GROUP BY method, station_id)
SELECT method, count(*) AS n_stations, round(avg(abs(mbe)), 6) AS mean_abs_mbe FROM st
WHERE station_id IN (SELECT station_id FROM fx_station WHERE typ_oblasti = 'R') GROUP BY method"""))
