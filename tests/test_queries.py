import pytest
from pyspark.sql import functions as F

import fillwise.plans  # noqa: F401
from fillwise.operators import scenarios
from fillwise.plans import models, registry, validation
from fillwise.plans.fixtures import fixture
from tests.oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(spark, registry.queries()[name], registry.oracle_sql()[name])


def rungs_differ(rows):
    sizes = {r["model"]: r["n_features"] for r in rows}
    assert sizes == {"M0": 16, "M1": 33, "M2": 42, "M3": 48, "M4": 50, "M5": 51, "V": 39, "M4 unconstrained": 50}
    assert {r["scheme"] for r in rows} == {"kfold", "stations", "station median"} and len({r["n"] for r in rows}) == 1


def shares_add_up(rows):
    single, sums = [r for r in rows if r["feature"]], {r["grp"]: r for r in rows if not r["feature"]}
    assert len(single) == 50 and len(sums) == 9 and sum(r["share"] for r in single) == pytest.approx(1, abs=1e-4)
    for label, whole in sums.items():
        mine = [r for r in single if r["grp"] == label]
        assert whole["splits"] == sum(r["splits"] for r in mine) and whole["share"] == pytest.approx(sum(r["share"] for r in mine), abs=1e-4)
    assert all((r["gain"] > 0) == (r["splits"] > 0) for r in single)


def places_follow_contributions(rows):
    rows = sorted(rows, key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(1, 52)) and rows[0]["mean_abs"] > 0
    assert all(a["mean_abs"] >= b["mean_abs"] for a, b in zip(rows, rows[1:], strict=False))


def bins_are_full(rows):
    assert {r["feature"] for r in rows} <= set(scenarios.DRIVERS) and len({r["feature"] for r in rows}) >= 5
    for name in {r["feature"] for r in rows}:
        mine = sorted((r["bin"], r["x_median"]) for r in rows if r["feature"] == name)
        assert [x for _, x in mine] == sorted(x for _, x in mine)


def every_weight_is_scored(rows):
    offsets = {"none" if o is None else str(o) for o in validation.WEIGHT_OFFSETS}
    assert {(r["scheme"], r["offset"]) for r in rows} == {(s, o) for s in ("kfold", "stations") for o in offsets} and len({r["n"] for r in rows}) == 1


#: What is known of the results of queries that SQL cannot express.
KNOWN = {
    "ablation_ladder": rungs_differ, "boosted_importance": shares_add_up, "boosted_attribution": places_follow_contributions,
    "attribution_trends": bins_are_full, "boosted_weights": every_weight_is_scored,
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    got = registry.queries()[name](spark, SF)
    if name in KNOWN:
        KNOWN[name](got.collect())
    else:
        assert got.count() > 0


def test_fills_cover_every_station_day(spark):
    stations, days = fixture(spark, SF, "fx_station"), fixture(spark, SF, "fx_series").select("datum").distinct()
    observed, everything = fixture(spark, SF, "fx_series").count(), stations.count() * days.count()
    for name in ("boosted_fill", "filled_series"):
        got = registry.queries()[name](spark, SF)
        assert set(got.columns) == {"station_id", "datum", "bap", "bap_predicted", "bap_filled", "is_observed"}
        n, keys, n_observed, n_filled, gap_fills, same = got.agg(
            F.count("*"), F.countDistinct("station_id", "datum"), F.sum("is_observed"), F.count("bap_filled"),
            F.countDistinct(F.when(F.col("is_observed") == 0, F.col("bap_filled"))), F.bool_and(F.col("bap_filled") == F.coalesce("bap", "bap_predicted")),
        ).first()
        assert (n, keys, n_observed, n_filled, same) == (everything, everything, observed, everything, True) and gap_fills > 10


def test_streamed_upserts_writes_in_parallel(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "scratch", lambda *_: f"file://{tmp_path}")
    monkeypatch.setattr(models, "fixture", lambda *a: fixture(*a).repartition(4))
    assert_same(spark, registry.queries()["streamed_upserts"], registry.oracle_sql()["streamed_upserts"])
    assert [len(list(tmp_path.glob(f"in/part={k}/*.parquet"))) for k in (0, 1)] == [4, 4]
    assert {p.name for p in tmp_path.glob("table/version=*")} == {"version=0", "version=1"}
