"""Queries from hourly rows and observations to station-days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.functions import scalar as X
from fillwise.operators import daily, metrics, recon
from fillwise.plans.fixtures import CLEAN_NAME, fixture, with_fixtures
from fillwise.plans.registry import register
from fillwise.sources import tables

DAILY = (
    "t_mean t_range heating_degree_hours vrate_min hpbl_min total_rain ws_max wdir_sin wdir_cos ssrd_total sp_mean rh_mean "
    "night_vrate_avg night_sshf_min doy_sin doy_cos"
).split()
HISTORY = (
    "hpbl_min_3d hpbl_min_7d vrate_min_3d t_mean_3d t_mean_lag1 hpbl_min_lag1 sp_tendency pm10_mean_lag1 pm25_mean_lag1 no2_mean_lag1 "
    "pm10_mean_3d pm25_mean_3d no2_mean_3d"
).split()

_NIGHT = "hr IN (20, 21, 22, 23, 0, 1, 2, 3, 4, 5)"
_DAILY = f""", h AS (SELECT *, hpbl * sqrt(u10 * u10 + v10 * v10) AS vrate, t2m - 273.15 AS t FROM fx_hourly),
d AS (SELECT station_id, datum, avg(t) AS t_mean, max(t) - min(t) AS t_range,
  coalesce(sum(CASE WHEN t IS NOT NULL THEN greatest(0, 15.5 - t) END), 0) AS heating_degree_hours, min(vrate) AS vrate_min, min(hpbl) AS hpbl_min,
  coalesce(sum(rain), 0) AS total_rain, max(sqrt(u10 * u10 + v10 * v10)) AS ws_max,
  sin(atan2(avg(u10), avg(v10))) AS wdir_sin, cos(atan2(avg(u10), avg(v10))) AS wdir_cos, coalesce(sum(ssrd), 0) AS ssrd_total,
  avg(sp) AS sp_mean, avg(rh) AS rh_mean, avg(CASE WHEN {_NIGHT} THEN vrate END) AS night_vrate_avg, min(CASE WHEN {_NIGHT} THEN sshf END) AS night_sshf_min,
  CASE WHEN isodow(datum) >= 6 THEN 1 ELSE 0 END AS is_weekend, month(datum) AS month,
  CASE WHEN month(datum) IN (10, 11, 12, 1, 2, 3, 4) THEN 1 ELSE 0 END AS heating_season,
  sin(2 * pi() * dayofyear(datum) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(datum) / 365.25) AS doy_cos FROM h GROUP BY station_id, datum)"""
_PROXY = """, px AS (SELECT station_id, datum, avg(value) FILTER (pollutant = 'pm10') AS pm10_mean, avg(value) FILTER (pollutant = 'pm25') AS pm25_mean,
  avg(value) FILTER (pollutant = 'no2') AS no2_mean FROM fx_proxy_hourly GROUP BY station_id, datum)"""
_HISTORY = _DAILY + _PROXY + """, j AS (SELECT d.*, pm10_mean, pm25_mean, no2_mean FROM d LEFT JOIN px ON d.station_id = px.station_id AND d.datum = px.datum),
w AS (SELECT *, avg(hpbl_min) OVER w3 AS hpbl_min_3d, avg(hpbl_min) OVER w7 AS hpbl_min_7d, avg(vrate_min) OVER w3 AS vrate_min_3d,
  avg(t_mean) OVER w3 AS t_mean_3d, lag(t_mean) OVER w1 AS t_mean_lag1, lag(hpbl_min) OVER w1 AS hpbl_min_lag1,
  sp_mean - lag(sp_mean) OVER w1 AS sp_tendency, lag(pm10_mean) OVER w1 AS pm10_mean_lag1, lag(pm25_mean) OVER w1 AS pm25_mean_lag1,
  lag(no2_mean) OVER w1 AS no2_mean_lag1, avg(pm10_mean) OVER w3 AS pm10_mean_3d, avg(pm25_mean) OVER w3 AS pm25_mean_3d, avg(no2_mean) OVER w3 AS no2_mean_3d,
  CASE WHEN ws_max < 2.0 AND total_rain < 1.0 THEN 1 ELSE 0 END AS stag FROM j
  WINDOW w1 AS (PARTITION BY station_id ORDER BY datum), w3 AS (PARTITION BY station_id ORDER BY datum ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  w7 AS (PARTITION BY station_id ORDER BY datum ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
i AS (SELECT *, sum(1 - stag) OVER (PARTITION BY station_id ORDER BY datum) AS island FROM w),
f AS (SELECT *, CAST(sum(stag) OVER (PARTITION BY station_id, island ORDER BY datum) AS BIGINT) AS stagnation_run FROM i)"""


def _rounds(names: list[str]) -> str:
    return ", ".join(f"round({c}, 6) + 0 AS {c}" for c in names)


def _day(df: DataFrame) -> DataFrame:
    return metrics.rounded(df.withColumn("datum", F.col("datum").cast("string")))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.station_days(fixture(spark, sf_dir, "fx_hourly").drop("datum"), fixture(spark, sf_dir, "fx_proxy_hourly").drop("datum"))


def daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(daily.daily_features(fixture(spark, sf_dir, "fx_hourly").drop("datum")))


register("daily_features", daily_features, with_fixtures("fx_hourly", _DAILY + f"""
SELECT station_id, CAST(datum AS VARCHAR) AS datum, {_rounds(DAILY)}, is_weekend, month, heating_season FROM d"""))


def proxy_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(daily.proxy_daily(fixture(spark, sf_dir, "fx_proxy_hourly").drop("datum")))


register("proxy_daily", proxy_daily, with_fixtures("fx_proxy_hourly", _PROXY + f"""
SELECT station_id, CAST(datum AS VARCHAR) AS datum, {_rounds(["pm10_mean", "pm25_mean", "no2_mean"])} FROM px"""))


def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(days(spark, sf_dir).select("station_id", "datum", *HISTORY, "stagnation_run"))


register("history_features", history_features, with_fixtures("fx_hourly fx_proxy_hourly", _HISTORY + f"""
SELECT station_id, CAST(datum AS VARCHAR) AS datum, {_rounds(HISTORY)}, stagnation_run FROM f"""))


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed station-days with features, station dimension and weights."""
    rows = daily.training_view(days(spark, sf_dir), fixture(spark, sf_dir, "fx_obs"))
    stations = fixture(spark, sf_dir, "fx_station").select("station_id", X.area_code("typ_oblasti").alias("typ_oblasti_code"), "altitude")
    out = rows.join(stations, "station_id").withColumns({"weight": X.sample_weight("bap"), "y": X.log1p("bap")})
    return _day(out.select("station_id", "datum", "bap", "t_mean", "hpbl_min_3d", "pm10_mean", "stagnation_run", "typ_oblasti_code", "altitude", "weight", "y"))


register("training_table", training_table, with_fixtures("fx_hourly fx_proxy_hourly fx_obs fx_station", _HISTORY + """
SELECT f.station_id, CAST(f.datum AS VARCHAR) AS datum, round(bap, 6) AS bap, round(t_mean, 6) AS t_mean, round(hpbl_min_3d, 6) AS hpbl_min_3d,
  round(pm10_mean, 6) AS pm10_mean, stagnation_run, CASE typ_oblasti WHEN 'S' THEN 1 WHEN 'U' THEN 2 ELSE 0 END AS typ_oblasti_code, round(altitude, 6) AS altitude,
  round(1 / (bap + 0.5), 6) AS weight, round(ln(1 + bap), 6) AS y
FROM f JOIN fx_obs o ON f.station_id = o.station_id AND f.datum = o.datum JOIN fx_station s ON f.station_id = s.station_id"""))


def gap_filled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All station-days with a predictor that SQL can state: the station's mean, else the mean of all."""
    obs = fixture(spark, sf_dir, "fx_obs")
    means = obs.groupBy("station_id").agg(F.avg("bap").alias("__s"))
    overall = obs.agg(F.avg("bap").alias("__g"))
    frame = days(spark, sf_dir).select("station_id", "datum", "t_mean").join(means, "station_id", "left").crossJoin(F.broadcast(overall))
    return _day(daily.fill_view(frame, obs, F.coalesce("__s", "__g")).drop("__s", "__g"))


register("gap_filled_days", gap_filled_days, with_fixtures("fx_hourly fx_obs", _DAILY + """,
m AS (SELECT station_id, avg(bap) AS s FROM fx_obs GROUP BY 1), g AS (SELECT avg(bap) AS g FROM fx_obs)
SELECT d.station_id, CAST(d.datum AS VARCHAR) AS datum, round(t_mean, 6) AS t_mean, round(bap, 6) AS bap, round(coalesce(s, g), 6) AS bap_predicted,
  CASE WHEN bap IS NULL THEN 0 ELSE 1 END AS is_observed, round(coalesce(bap, s, g), 6) AS bap_filled
FROM d LEFT JOIN fx_obs o ON d.station_id = o.station_id AND d.datum = o.datum LEFT JOIN m ON d.station_id = m.station_id, g"""))


def station_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of the network on the grid, with cleaned names and codes."""
    s = fixture(spark, sf_dir, "fx_station").where(F.trim("eoi").startswith("SK") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    x, y = X.project("lon", "lat")
    s = s.withColumns({"x": X.node(x, X.GRID_X0, X.GRID_STEP), "y": X.node(y, X.GRID_Y0, X.GRID_STEP)})
    s = s.where(F.col("x").between(0, X.GRID_NX - 1) & F.col("y").between(0, X.GRID_NY - 1))
    return s.select(
        F.trim("eoi").alias("eoi"), "x", "y", X.clean_name("name").alias("name"), X.short_name("name").alias("short_name"),
        X.type_code("typ_oblasti", "typ_zdroja").alias("type"), X.area_code("typ_oblasti").alias("area_code"),
    )


_N, _F, _R0 = X.CONE
register("station_dimension", station_dimension, with_fixtures("fx_station", f""",
q AS (SELECT *, {X.RADIUS:.10e} * {_F:.17e} / pow(tan(pi() / 4 + radians(lat) / 2), {_N:.17e}) AS rho, {_N:.17e} * radians(lon - {X.MERIDIAN:.17e}) AS a FROM fx_station),
n AS (SELECT *, CAST(round_even((rho * sin(a) - ({X.GRID_X0:.10e})) / {X.GRID_STEP:.10e}, 0) AS INT) AS x,
  CAST(round_even(({_R0:.17e} - rho * cos(a) - ({X.GRID_Y0:.10e})) / {X.GRID_STEP:.10e}, 0) AS INT) AS y FROM q)
SELECT eoi, x, y, {CLEAN_NAME} AS name, trim(split_part(name, ',', 1)) AS short_name, typ_oblasti || typ_zdroja AS type,
  CASE typ_oblasti WHEN 'S' THEN 1 WHEN 'U' THEN 2 ELSE 0 END AS area_code
FROM n WHERE x BETWEEN 0 AND {X.GRID_NX - 1} AND y BETWEEN 0 AND {X.GRID_NY - 1}"""))

_RECON = """, v AS (SELECT regexp_extract(samplingpoint, 'SPO-(SK[A-Za-z0-9_]+?)_05029', 1) AS eoi, CAST(start_ts AS DATE) AS datum,
  round_even(avg(round_even(value * 1e4, 0) / 1e4) * 1e4, 0) / 1e4 AS bap FROM fx_obs_raw WHERE validity = 1 AND verification = 1 AND samplingpoint LIKE '%\\_05029%' ESCAPE '\\' GROUP BY 1, 2),
c AS (SELECT * FROM fx_obs_current WHERE eoi NOT IN (SELECT eoi FROM v) OR year(datum) NOT IN (SELECT year(datum) FROM v))"""


def _verified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return recon.verified_daily(fixture(spark, sf_dir, "fx_obs_raw")), fixture(spark, sf_dir, "fx_obs_current")


def reconciled_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.reconcile(*_verified(spark, sf_dir)).withColumn("datum", F.col("datum").cast("string"))


register("reconciled_observations", reconciled_observations, with_fixtures("fx_obs_raw fx_obs_current", _RECON + """,
u AS (SELECT *, 'verified' AS source FROM v UNION ALL SELECT *, 'current' FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY eoi, datum ORDER BY CASE source WHEN 'verified' THEN 0 ELSE 1 END, bap DESC) AS k FROM u)
SELECT eoi, CAST(datum AS VARCHAR) AS datum, bap, source FROM r WHERE k = 1"""))


def reconciliation_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.impact(*_verified(spark, sf_dir))


register("reconciliation_impact", reconciliation_impact, with_fixtures("fx_obs_raw fx_obs_current", _RECON + """
SELECT count(*) AS n_overlap, count(*) FILTER (abs(round_even(v.bap * 1e3, 0) / 1e3 - round_even(k.bap * 1e3, 0) / 1e3) > 5e-3) AS n_differs
FROM v JOIN fx_obs_current k ON v.eoi = k.eoi AND v.datum = k.datum"""))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of the current table that the verified table lacks, and the other way round."""
    verified, current = _verified(spark, sf_dir)
    return recon.completeness(current, verified)


register("completeness", completeness, with_fixtures("fx_obs_raw fx_obs_current", _RECON + """
SELECT eoi, 'missing' AS state FROM (SELECT DISTINCT eoi FROM fx_obs_current EXCEPT SELECT eoi FROM v)
UNION ALL SELECT eoi, 'extra' FROM (SELECT DISTINCT eoi FROM v EXCEPT SELECT eoi FROM fx_obs_current)"""))


def registry_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered stations of the pollutant by their sampling points, with the area and source type that the metadata has."""
    points = fixture(spark, sf_dir, "fx_obs_raw").select(X.registry_code("samplingpoint").alias("code")).where("code IS NOT NULL").distinct()
    meta = fixture(spark, sf_dir, "fx_station").select(F.concat(F.lit(" "), "eoi").alias("EOI"), "typ_oblasti", "typ_zdroja").distinct()
    return tables.with_metadata(points, meta, "code", "EOI", ("typ_oblasti", "typ_zdroja"))


register("registry_stations", registry_stations, with_fixtures("fx_obs_raw fx_station", """
SELECT DISTINCT left(split_part(samplingpoint, 'SPO-', 2), 7) AS code, typ_oblasti, typ_zdroja
FROM fx_obs_raw JOIN fx_station ON left(split_part(samplingpoint, 'SPO-', 2), 7) = eoi WHERE contains(samplingpoint, '_05029_')"""))


def upserted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series with its even days of 1997 on delivered again, changed: the newest rows win."""
    s = fixture(spark, sf_dir, "fx_series").select("station_id", "datum", "bap")
    new = s.where("datum >= DATE '1997-01-01' AND day(datum) % 2 = 0").withColumn("bap", F.col("bap") + 1)
    return _day(tables.upsert(s, new, ["station_id", "datum"]))


register("upserted_series", upserted_series, with_fixtures("fx_series", """
SELECT station_id, CAST(datum AS VARCHAR) AS datum, round(CASE WHEN datum >= DATE '1997-01-01' AND day(datum) % 2 = 0 THEN bap + 1 ELSE bap END, 6) AS bap FROM fx_series"""))


def parsed_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations out of JSON lists that are built from the event rows: one list for each user and day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id IS NOT NULL")
    item = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.when(F.col("event_id") % 5 != 0, F.round("value", 4)).alias("value"))
    lists = e.groupBy(F.col("user_id").alias("eoi"), F.to_date("ts")).agg(F.to_json(F.collect_list(item)).alias("body"))
    out = tables.parse_observations(lists)
    return out.select("eoi", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "value")


register("parsed_observations", parsed_props, """
SELECT user_id AS eoi, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, round(value, 4) AS value FROM events WHERE event_id % 5 <> 0 AND value IS NOT NULL""")
