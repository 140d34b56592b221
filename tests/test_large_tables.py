"""Queries on large tables: results of what is cut into pieces, and how many rows plans make on the way."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fillwise.operators import boost, daily, grid, metrics, reports
from fillwise.plans import registry
from fillwise.plans.fixtures import fixture
from fillwise.sources import tables
from tests.oracle import SF

DAY = dt.date(2024, 1, 1)


def most_rows(df, of: str = "numOutputRows") -> int:
    """The largest number of rows that any node of the frame's plan has put out, or written to a shuffle."""
    df.collect()

    def walk(node):
        for inner in ("executedPlan", "plan"):
            if inner == "executedPlan" and "AdaptiveSparkPlan" in node.nodeName() or inner == "plan" and "QueryStage" in node.nodeName():
                return walk(getattr(node, inner)())
        metric = node.metrics().get(of)
        children = node.children()
        return max([metric.get().value() if metric.isDefined() else 0, *[walk(children.apply(k)) for k in range(children.size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def winds(spark, stations, n):
    rng = np.random.default_rng(6)
    turns = rng.uniform(-np.pi, np.pi, (stations, n))
    data = [(s, DAY + dt.timedelta(days=k), float(np.sin(turns[s, k])), float(np.cos(turns[s, k]))) for s in range(stations) for k in range(n)]
    return data, spark.createDataFrame([*data, (0, DAY + dt.timedelta(days=9999), None, 0.5), (None, DAY, 0.0, 1.0), (77, DAY, 0.0, 1.0)], "station_id long, datum date, wdir_sin double, wdir_cos double")


def test_wind_sums_equal_those_over_all_pairs(spark, monkeypatch):
    """Two stations at one place, a source at a station and two at one place; stations and sources dealt over groups and not."""
    rng = np.random.default_rng(5)
    places = [*(tuple(p) for p in rng.uniform(-50_000, 50_000, (4, 2))), (10.0, 20.0), (10.0, 20.0)]
    sources = [(*p, float(q)) for p, q in zip(rng.uniform(-60_000, 60_000, (60, 2)).tolist(), rng.uniform(0, 900, 60), strict=True)] + [(10.0, 20.0, 9.0), (500.0, 20.0, 7.0), (500.0, 20.0, 5.0), (0.0, 0.0, -4.0), (None, 1.0, 3.0)]
    data, days = winds(spark, 6, 12)
    stations = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places)], "station_id long, x double, y double")
    table = spark.createDataFrame([(None if a is None else float(a), float(b), q) for a, b, q in sources], "sx double, sy double, bap double")

    def pull(s, sin, cos):
        total = 0.0
        for sx, sy, q in sources:
            if sx is None or q <= 0:
                continue
            dx, dy = places[s][0] - sx, places[s][1] - sy
            d = np.hypot(dx, dy)
            if 0 < d < grid.RADIUS_M:
                total += q * np.exp(-d / grid.DECAY_M) * max(0.0, sin * dx / d + cos * dy / d)
        return np.log1p(total)

    want = {(s, day): pull(s, sin, cos) for s, day, sin, cos in data}
    for each in (100_000, 2):
        monkeypatch.setattr(grid, "STATIONS_EACH", each)
        monkeypatch.setattr(grid, "SOURCES_EACH", 10 * each)
        got = {(r["station_id"], r["datum"]): r["wdir_emis_bap_log"] for r in grid.directional_emission(days, stations, table).collect()}
        assert len(got) == len(want) + 3 and sorted(got[k] for k in set(got) - set(want)) == [0.0, 0.0, pytest.approx(pull(0, 0.0, 0.0))]
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-9)


def test_days_and_sources_make_no_pairs(spark):
    _, days = winds(spark, 2, 1000)
    stations = spark.createDataFrame([(0, 1000.0, 1000.0), (1, 1500.0, 500.0)], "station_id long, x double, y double")
    sources = spark.range(200).select((F.col("id") * 37 % 9000).cast("double").alias("sx"), (F.col("id") * 91 % 7000).cast("double").alias("sy"), F.lit(1.0).alias("bap"))
    assert most_rows(grid.directional_emission(days, stations, sources)) < 50_000  # 400,000 pairs of days and sources


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["filled_series", "boosted_fill"])
def test_fills_shuffle_no_row_for_each_day(spark, no_broadcasts, name):
    out = registry.queries()[name](spark, SF)
    assert most_rows(out, "shuffleRecordsWritten") < 30_000 < out.count() / 10


def test_fills_keep_repeated_rows_and_stations(spark):
    day = lambda k: dt.date(2024, k, 1)
    series = spark.createDataFrame([(1, day(1), 1.0), (1, day(2), 4.0), (1, day(2), 6.0), (2, day(1), None), (None, day(3), 7.0)], "station_id long, datum date, bap double")
    stations = spark.createDataFrame([(1,), (2,), (3,), (3,)], "station_id long")
    got = sorted((r["station_id"], r["datum"], r["bap"] or 0.0, r["bap_predicted"], r["bap_filled"], r["is_observed"]) for r in reports.fill_with_climatology(series, stations).collect())
    overall = {1: 1.0, 2: 5.0, 3: 7.0}
    one = [(1, day(1), 1.0, 1.0, 1.0, 1), (1, day(2), 4.0, 5.0, 4.0, 1), (1, day(2), 6.0, 5.0, 6.0, 1), (1, day(3), 0.0, pytest.approx(11 / 3), pytest.approx(11 / 3), 0)]
    others = [(s, day(k), 0.0, overall[k], overall[k], 0) for s in (2, 3, 3) for k in (1, 2, 3)]
    assert got == one + sorted(others)


def test_chunks_are_opened_once_for_each_node(spark):
    """Many stations at one node: its chunk's arrays meet the node, not each station."""
    long = spark.createDataFrame([("meteo_20240101.nc", None, h, 1, 1, float(h)) for h in range(24)], "file string, base string, h int, y int, x int, t double")
    stations = spark.range(300).select("id", F.lit(1).alias("x"), F.lit(1).alias("y"))
    out = tables.read_chunks(tables.chunked_cube(long, ["file", "base"], ["t"]), stations, ["t"], key="id")
    got = out.collect()
    assert len(got) == 7200 and {(r["time"].hour, r["t"]) for r in got} == {(h, float(h)) for h in range(24)}
    assert opened(out) == 24


def opened(df) -> int:
    """Rows that the innermost array of the plan is laid out to: hours of chunks."""
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Generate" in name:
            found.append(node.metrics().get("numOutputRows").get().value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    return min(found)


def test_registry_stations_are_told_once(spark, tmp_path):
    """Codes of five digits repeat above 99,999 stations: equal rows are one row, as in SQL."""
    for name in ("nation", "customer", "orders"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        shift = {"customer": ["c_custkey"], "orders": ["o_custkey"]}.get(name)
        df = df.withColumns({c: F.when(F.col(c) % 2 == 0, F.col(c) + 100_000).otherwise(F.col(c)) for c in shift}) if shift else df
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("nation", "customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["registry_stations"]).fetchall())
    got = sorted(tuple(r) for r in registry.queries()["registry_stations"](spark, str(tmp_path)).collect())
    assert got == want and len({g[0] for g in got}) < len(got)


def many_folds(spark, n=3000):
    rng = np.random.default_rng(2)
    data = [(k % 40 if k % 41 else None, *[float(v) if rng.random() > 0.1 else None for v in x], float(np.exp(x[0] / 2 + rng.normal() / 5 + x[1] * x[2] / 10))) for k, x in enumerate(rng.normal(size=(n, 3)))]
    return spark.createDataFrame(data, "station_id long, a double, b double, c double, bap double")


@pytest.mark.parametrize("options", [{"trees": 3, "depth": 2, "directions": {"a": 1}}, {"trees": 2, "depth": 3, "directions": {}, "l1": 0.1}])
def test_models_by_structure_equal_models_one_by_one(spark, monkeypatch, options):
    """Folds that a task holds whole, and folds in pieces; few structures are added up, and in small groups."""
    df, added, keep = many_folds(spark), [], boost._Shared._totals
    monkeypatch.setattr(boost, "MIN_SHARED", 1 << 30)
    alone = boost.fit_folds(df, ["a", "b", "c"], "station_id", **options)
    monkeypatch.setattr(boost, "MIN_SHARED", 16)
    monkeypatch.setattr(boost._Shared, "_totals", lambda self, t, level, packed, leaves: added.append(len(leaves)) or keep(self, t, level, packed, leaves))
    for rows_each, most in ((100_000, 500_000), (20, 4_000)):
        monkeypatch.setattr(boost, "ROWS_EACH", rows_each)
        monkeypatch.setattr(boost, "MAX_SUMS", most)
        monkeypatch.setattr(boost, "CHOSEN_EACH", 7)
        together = boost.fit_folds(df, ["a", "b", "c"], "station_id", **options)
        assert isinstance(together, boost.Forest) and list(together) == list(alone) and len(alone) == 40
        for fold, one in alone.items():
            other = together[fold]
            assert other.base == one.base and other.splits == one.splits and other.gains == pytest.approx(one.gains)
            for x, y, c, d in zip(one.trees, other.trees, one.covers, other.covers, strict=True):
                assert {n: t[:3] for n, t in x.items()} == {n: t[:3] for n, t in y.items()} and c == d
                assert [t[3] for t in x.values()] == pytest.approx([t[3] for t in y.values()], abs=1e-7)
        key = lambda m: {r["a"]: r["pred"] for r in boost.predict_folds(df, m, "station_id").where("a IS NOT NULL").collect()}
        assert key(together) == pytest.approx(key(dict(alone)), abs=1e-6)
    assert sum(added) < 40 * options["trees"] * options["depth"]  # a sum for each model and level before


def test_rows_of_a_leaf_higher_up_are_in_no_lower_node(spark):
    """Where one side of the root is a leaf and the other splits twice, the leaf's rows are in no sum below."""
    data = [(float(a), float(b), float(c), 99.0 if not a else 1.0 + 9 * b + 20 * b * c + 4 * c) for a in (0, 1) for b in (0, 1) for c in (0, 1) for _ in range(40)]
    df = spark.createDataFrame(data, "a double, b double, c double, bap double")
    model = boost.fit_monotone(df, ["a", "b", "c"], directions={}, trees=1, depth=3, offset=None)
    tree, cover = model.trees[0], model.covers[0]
    assert {n for n, t in tree.items() if t[0] < 0} == {2, 12, 13, 14, 15} and cover[2] == cover[3] == 160
    assert all(cover[n] == cover[2 * n] + cover[2 * n + 1] for n, t in tree.items() if t[0] >= 0)


def test_observed_days_equal_days_joined_with_observations(spark, no_broadcasts):
    """History comes from all days, repeated observations repeat the day; and the days are shuffled for their history only."""
    hourly, proxies = (fixture(spark, SF, name).drop("datum") for name in ("fx_hourly", "fx_proxy_hourly"))
    obs = fixture(spark, SF, "fx_obs")
    obs = obs.unionByName(obs.where("station_id % 3 = 0").withColumn("bap", F.col("bap") + 1)).unionByName(obs.where("station_id % 5 = 1").withColumn("bap", F.lit(None).cast("double")))
    got, want = daily.observed_days(daily.daily_features(hourly), proxies, obs), daily.training_view(daily.station_days(hourly, proxies), obs)
    rows = lambda df: sorted(str(r) for r in metrics.rounded(df.select(*sorted(want.columns))).collect())
    assert set(got.columns) == set(want.columns) and rows(got) == rows(want)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hash")
    assert shuffles(got) < shuffles(want)


#: Queries that leave each station out alone.
STATIONS_OUT = ["ablation_ladder", "boosted_loso", "boosted_weights", "rural_yearly_means", "emission_focus"]


@pytest.mark.parametrize("name", STATIONS_OUT)
def test_no_model_of_many_folds_reads_all_rows_alone(spark, monkeypatch, name):
    """Rows are not visited once for each station's model."""
    few, keep = [], boost._Group.__init__
    monkeypatch.setattr(boost._Group, "__init__", lambda self, rows, models, *rest: few.append(len(models)) or keep(self, rows, models, *rest))
    assert registry.queries()[name](spark, SF).count() > 0
    assert max(few, default=0) < boost.MIN_SHARED
