"""Hourly rows to daily features, and features of a station's row history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwise.functions import scalar as X

OPTIONAL = ("ssrd", "sp", "rh")
PROXIES = ("pm10", "pm25", "no2")


def with_optional_columns(df: DataFrame, names: tuple[str, ...] = OPTIONAL) -> DataFrame:
    """Missing optional columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast("double") for c in names if c not in df.columns})


def with_ventilation(hourly: DataFrame) -> DataFrame:
    return hourly.withColumn("vrate", F.col("hpbl") * X.magnitude("u10", "v10"))


def hourly_inputs(hourly: DataFrame) -> DataFrame:
    """Hourly rows with ventilation, temperature in degrees and whether it is night."""
    h = with_ventilation(with_optional_columns(hourly))
    return h.withColumns({"t": X.celsius("t2m"), "night": F.hour("time").isin(*X.NIGHT_HOURS)})


def daily_aggregates(absent: set[str] = frozenset()) -> list[Column]:
    """Every daily feature as an aggregate of hourly_inputs; all are partial sums and extremes, so that batches and streams merge them."""
    angle = F.atan2(F.avg("u10"), F.avg("v10"))
    radiation = F.lit(None).cast("double") if "ssrd" in absent else F.coalesce(F.sum("ssrd"), F.lit(0.0))
    return [
        F.avg("t").alias("t_mean"),
        (F.max("t") - F.min("t")).alias("t_range"),
        F.coalesce(F.sum(F.greatest(F.lit(0.0), F.when(F.col("t").isNotNull(), X.HEATING_BASE_C - F.col("t")))), F.lit(0.0)).alias(
            "heating_degree_hours"
        ),
        F.min("vrate").alias("vrate_min"),
        F.min("hpbl").alias("hpbl_min"),
        F.coalesce(F.sum("rain"), F.lit(0.0)).alias("total_rain"),
        F.max(X.magnitude("u10", "v10")).alias("ws_max"),
        F.sin(angle).alias("wdir_sin"),
        F.cos(angle).alias("wdir_cos"),
        radiation.alias("ssrd_total"),
        F.avg("sp").alias("sp_mean"),
        F.avg("rh").alias("rh_mean"),
        F.avg(F.when(F.col("night"), F.col("vrate"))).alias("night_vrate_avg"),
        F.min(F.when(F.col("night"), F.col("sshf"))).alias("night_sshf_min"),
    ]


def with_calendar(daily: DataFrame) -> DataFrame:
    return daily.withColumns(
        {
            "is_weekend": X.is_weekend("datum"),
            "month": F.month("datum"),
            "heating_season": X.is_heating_season("datum"),
            "doy_sin": X.season_sin("datum"),
            "doy_cos": X.season_cos("datum"),
        }
    )


def absent_columns(hourly: DataFrame) -> set[str]:
    return {c for c in OPTIONAL if c not in hourly.columns}


def daily_features(hourly: DataFrame, key: str = "station_id") -> DataFrame:
    """One row for each station and date, from one shuffle with map-side sums. Night hours are those of the same date."""
    h = hourly_inputs(hourly).withColumn("datum", F.to_date("time"))
    return with_calendar(h.groupBy(key, "datum").agg(*daily_aggregates(absent_columns(hourly))))


def proxy_daily(proxies: DataFrame, key: str = "station_id") -> DataFrame:
    """Daily means of the proxy pollutants side by side, in one shuffle."""
    means = {f"{p}_mean": F.avg(F.when(F.col("pollutant") == p, F.col("value"))) for p in PROXIES}
    return proxies.groupBy(key, F.to_date("time").alias("datum")).agg(*[m.alias(n) for n, m in means.items()])


def temporal_features(daily: DataFrame, key: str = "station_id", day: str = "datum") -> DataFrame:
    """Rolling means, lags, tendency and stagnation run over a station's rows in date order (rows, not calendar days)."""
    daily = with_optional_columns(daily, tuple(f"{p}_mean" for p in PROXIES))
    w = Window.partitionBy(key).orderBy(day)

    def mean(c: str, rows: int) -> Column:
        return F.avg(c).over(w.rowsBetween(1 - rows, 0))

    def before(c: str) -> Column:
        return F.lag(c).over(w)

    stagnant = F.when((F.col("ws_max") < X.STAGNATION_WIND) & (F.col("total_rain") < X.STAGNATION_RAIN), 1).otherwise(0)
    island = Window.partitionBy(key, "__island").orderBy(day)
    out = daily.withColumns(
        {
            "hpbl_min_3d": mean("hpbl_min", 3),
            "hpbl_min_7d": mean("hpbl_min", 7),
            "vrate_min_3d": mean("vrate_min", 3),
            "t_mean_3d": mean("t_mean", 3),
            "t_mean_lag1": before("t_mean"),
            "hpbl_min_lag1": before("hpbl_min"),
            "sp_tendency": F.col("sp_mean") - before("sp_mean"),
            **{f"{p}_mean_lag1": before(f"{p}_mean") for p in PROXIES},
            **{f"{p}_mean_3d": mean(f"{p}_mean", 3) for p in PROXIES},
            "__stagnant": stagnant,
        }
    )
    out = out.withColumn("__island", F.sum(1 - F.col("__stagnant")).over(w))
    return out.withColumn("stagnation_run", F.sum("__stagnant").over(island)).drop("__stagnant", "__island")


def station_days(hourly: DataFrame, proxies: DataFrame, key: str = "station_id") -> DataFrame:
    """Daily features with proxies where there are any, and the history features over all days."""
    return temporal_features(daily_features(hourly, key).join(proxy_daily(proxies, key), [key, "datum"], "left"), key)


def training_view(days: DataFrame, obs: DataFrame, key: str = "station_id") -> DataFrame:
    """Observed station-days; repeated observations repeat the row."""
    return days.join(obs.dropna(subset=["bap"]), [key, "datum"])


def observed_days(daily: DataFrame, proxies: DataFrame, obs: DataFrame, key: str = "station_id") -> DataFrame:
    """What station_days and training_view give of daily features: observations meet the days, as the proxies do, before history is taken.

    All three are tables by station and day, so that days are shuffled for their history only. A day's observations are one array until then.
    """
    others = [c for c in obs.columns if c not in (key, "datum")]
    lists = obs.dropna(subset=["bap"]).groupBy(key, "datum").agg(F.collect_list(F.struct(*others)).alias("__obs"))
    out = temporal_features(daily.join(proxy_daily(proxies, key), [key, "datum"], "left").join(lists, [key, "datum"], "left"), key)
    return out.where("__obs IS NOT NULL").select("*", F.inline("__obs")).drop("__obs")


def fill_view(days: DataFrame, obs: DataFrame, predicted: Column, key: str = "station_id") -> DataFrame:
    """All station-days: the observation where there is one, else the prediction."""
    out = days.join(obs, [key, "datum"], "left").withColumn("bap_predicted", predicted)
    return out.withColumns(
        {"is_observed": F.col("bap").isNotNull().cast("int"), "bap_filled": F.coalesce("bap", "bap_predicted")}
    )
