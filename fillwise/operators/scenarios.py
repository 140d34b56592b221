"""Feature sets as data, and comparisons over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwise.operators import linear, metrics

# Fixed values of the study: the model's features by group.
GROUPS = {
    "base": [
        "t_mean", "heating_degree_hours", "vrate_min", "hpbl_min", "night_vrate_avg", "night_sshf_min", "total_rain", "ws_max",
        "is_weekend", "month", "pm10_mean", "pm25_mean", "no2_mean", "typ_oblasti_code", "typ_zdroja_code", "altitude",
    ],
    "derived": [
        "t_range", "wdir_sin", "wdir_cos", "ssrd_total", "sp_mean", "rh_mean", "doy_sin", "doy_cos", "heating_season", "hpbl_min_3d",
        "hpbl_min_7d", "vrate_min_3d", "t_mean_3d", "t_mean_lag1", "hpbl_min_lag1", "sp_tendency", "stagnation_run",
    ],
    "spatial": [
        "elev_mean", "elev_relief", "tpi_local", "tpi_meso", "tpi_broad", "slope_deg", "traffic_load_log", "traffic_hdv_log",
        "dist_major_road_km",
    ],
    "lags": ["pm10_mean_lag1", "pm25_mean_lag1", "no2_mean_lag1", "pm10_mean_3d", "pm25_mean_3d", "no2_mean_3d"],
    "emission": ["emis_bap_log", "emis_pm25_log"],
    "directional": ["wdir_emis_bap_log"],
    "population": ["pop_log"],
}
RUNGS = ("base", "derived", "spatial", "lags", "emission", "population")


def resolve(columns: list[str], *groups: str) -> list[str]:
    """Features of the groups that the table has."""
    return [c for g in groups for c in GROUPS[g] if c in columns]


def ladder(columns: list[str]) -> dict[str, list[str]]:
    """M0 to M5, each rung adding a group; V is M4 without proxies and typology."""
    out = {f"M{i}": resolve(columns, *RUNGS[: i + 1]) for i in range(len(RUNGS))}
    out["V"] = proxy_free(out["M4"])
    return out


def group_of(feature: str) -> str:
    return next((g for g, names in GROUPS.items() if feature in names), "other")


# Fixed values of the study: labels of features in reports; a feature without one is derived meteorology.
LABELS = {
    "Proxy (same-day PM/NO₂)": ["pm10_mean", "pm25_mean", "no2_mean"],
    "Concentration lag": ["pm10_mean_lag1", "pm25_mean_lag1", "no2_mean_lag1", "pm10_mean_3d", "pm25_mean_3d", "no2_mean_3d"],
    "Terrain (DEM)": ["elev_mean", "elev_relief", "tpi_local", "tpi_meso", "tpi_broad", "slope_deg", "altitude"],
    "Traffic": ["traffic_load_log", "traffic_hdv_log", "dist_major_road_km"],
    "Emission (bottom-up)": ["emis_bap_log", "emis_pm25_log", "pop_log", "wdir_emis_bap_log"],
    "Calendar/season": ["is_weekend", "month", "doy_sin", "doy_cos", "heating_season"],
    "Station typology": ["typ_oblasti_code", "typ_zdroja_code"],
    "Meteorology (base)": ["t_mean", "heating_degree_hours", "vrate_min", "hpbl_min", "night_vrate_avg", "night_sshf_min", "total_rain", "ws_max"],
}
DERIVED_LABEL = "Meteorology (derived)"
DRIVERS = ["tpi_local", "hpbl_min", "heating_degree_hours", "emis_bap_log", "t_mean", "doy_cos"]


def label_of(feature: str) -> str:
    """The label of a feature, one of nine."""
    return next((label for label, names in LABELS.items() if feature in names), DERIVED_LABEL)


def proxy_free(features: list[str]) -> list[str]:
    """The features that a place without a station has: no proxies, their lags, or typology."""
    return [c for c in features if not c.startswith(("pm10", "pm25", "no2", "typ_"))]


def compare_feature_sets(df: DataFrame, sets: dict[str, list[str]], fold: str, y: str = "bap") -> DataFrame:
    """Metrics of out-of-fold ridge by feature set; each set is one pass over the rows."""
    parts = [
        linear.ridge_oof(df, features, fold, y).select(F.lit(name).alias("scenario"), F.col(y).alias("y"), F.col("ridge").alias("pred"))
        for name, features in sets.items() if features
    ]
    return metrics.metrics_by(reduce(DataFrame.unionByName, parts), "scenario")


def compare_weights(df: DataFrame, features: list[str], offsets: list[float | None], fold: str, y: str = "bap") -> DataFrame:
    """Metrics of out-of-fold ridge by weight offset; None is unweighted."""
    parts = [
        linear.ridge_oof(df, features, fold, y, offset=o).select(F.lit("none" if o is None else str(o)).alias("scenario"), F.col(y).alias("y"), F.col("ridge").alias("pred"))
        for o in offsets
    ]
    return metrics.metrics_by(reduce(DataFrame.unionByName, parts), "scenario")
