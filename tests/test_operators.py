"""Micro-fixtures whose answers follow from the formulas, and invariants."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillwise.functions import scalar as X
from fillwise.operators import boost, daily, folds, grid, linear, metrics, quantiles, recon, scenarios
from fillwise.sources import tables
from fillwise.streaming import ingest

DAY = dt.date(2024, 1, 1)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def history(spark, **columns):
    n = len(next(iter(columns.values())))
    base = dict.fromkeys(("hpbl_min", "vrate_min", "t_mean", "sp_mean", "ws_max", "total_rain"), [1.0] * n) | columns
    data = [(1, DAY + dt.timedelta(days=k), *[float(v[k]) if v[k] is not None else None for v in base.values()]) for k in range(n)]
    return daily.temporal_features(spark.createDataFrame(data, "station_id long, datum date, " + ", ".join(f"{c} double" for c in base)))


def test_rolling_mean_needs_one_row(spark):
    assert [r[0] for r in rows(history(spark, t_mean=[1, None, 3]).orderBy("datum"), "t_mean_3d")] == [1.0, 1.0, 2.0]


def test_stagnation_run(spark):
    out = history(spark, ws_max=[1, 1, 9, 1], total_rain=[0, 0, 0, 0]).orderBy("datum")
    assert [r[0] for r in rows(out, "stagnation_run")] == [1, 2, 0, 1]


def test_lag_goes_by_rows(spark):
    df = spark.createDataFrame([(1, DAY + dt.timedelta(days=k), float(k), 1.0, 1.0, 1.0, 1.0, 1.0) for k in (1, 2, 5)],
        "station_id long, datum date, t_mean double, hpbl_min double, vrate_min double, sp_mean double, ws_max double, total_rain double")
    assert [r[0] for r in rows(daily.temporal_features(df).orderBy("datum"), "t_mean_lag1")] == [None, 1.0, 2.0]


def test_block_number(spark):
    df = spark.createDataFrame([(dt.date(2023, 6, 1),), (dt.date(2023, 7, 1),)], "datum date")
    assert sorted(r[0] for r in rows(folds.with_block(df), "block")) == [0, 1]


def test_baselines_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    data = [(int(s), dt.date(2023, 1, 1) + dt.timedelta(days=int(d)), float(rng.random())) for s in range(4) for d in sorted(rng.choice(200, 25, replace=False))]
    got = {(r["station_id"], r["datum"]): (r["clim"], r["persist"]) for r in folds.block_baselines(spark.createDataFrame(data, "station_id long, datum date, bap double")).collect()}
    first = min(d for _, d, _ in data)
    block = lambda d: (d - first).days // 30
    mean = lambda v: sum(v) / len(v) if v else None
    for s, d, _ in data:
        train = [r for r in data if block(r[1]) != block(d)]
        if sum(block(r[1]) == block(d) for r in data) < 3:
            assert (s, d) not in got
            continue
        own = [v for a, _, v in train if a == s]
        month = [v for a, x, v in train if a == s and x.month == d.month]
        before = [(x, v) for a, x, v in train if a == s and block(x) < block(d)]
        overall = mean([v for *_, v in train])
        clim, persist = got[s, d]
        assert clim == pytest.approx(next(v for v in (mean(month), mean(own), overall) if v is not None))
        assert persist == pytest.approx(max(before)[1] if before else next(v for v in (mean(own), overall) if v is not None))


def test_constant_prediction_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "y double, pred double")
    assert df.agg(*metrics.metric_columns()).first()["r2"] is None


def test_nodes_round_halves_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in rows(df.select(X.node("x", 0.0, 1.0).alias("n")), "n")] == [0, 2, 2]


def test_clean_name(spark):
    names = {"A , ,  B  c, mobil": "A, B c", "Town..,st.": "Town., st.", "Town .": "Town", "Mobile, x": "x", " , ": ""}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(X.clean_name("n")).collect()] == list(names.values())


def test_upsert_takes_the_new(spark):
    a, b = (spark.createDataFrame([(1, v)], "k int, v int") for v in (5, 7))
    assert rows(tables.upsert(a, b, ["k"]), "v") == [(7,)]


def test_parse_observations(spark):
    body = '[{"timestamp": "2024-01-01 00:00:00", "value": 1.5}, {"timestamp": "2024-01-01 01:00:00", "value": null}]'
    df = spark.createDataFrame([("a", body), ("b", '{"error": 1}'), ("c", None)], "eoi string, body string")
    assert rows(tables.parse_observations(df), "eoi", "value") == [("a", 1.5)]


def test_readers(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("EOI;NAME;LAT;LON;LOC;TYPE;ALT;II\n SK1 ;N;48.1;17.1;U;T;100;\n")
    assert tables.read_stations_meta(spark, str(tmp_path / "meta.csv")).first()["EOI"] == "SK1"
    (tmp_path / "x").mkdir()
    (tmp_path / "x/SK1_hourly.csv").write_text("time,v\n2024-01-01,NaN\n")
    got = tables.read_keyed_files(spark, str(tmp_path / "x/*.csv"), "time string, v double", r"^(\w+?)_hourly").first()
    assert (got["eoi"], got["v"]) == ("SK1", None)
    tables.write_table(spark.createDataFrame([(1, 2024)], "v int, year int"), str(tmp_path / "t"), ["year"])
    assert tables.select_years(spark.read.parquet(str(tmp_path / "t")), [2024]).count() == 1
    assert tables.Run("r").stage("v4") == "r/runs/default/stages/v4"


def test_missing_stations_raise(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "eoi string") for v in (["a", "b"], ["a", "c"]))
    with pytest.raises(ValueError, match="b"):
        recon.require_complete(a, b)


def test_fold_sizes_differ_by_one(spark):
    sizes = [r[1] for r in folds.with_kfold(spark.range(103).toDF("k"), [F.col("k")]).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_flat_field_has_no_position_index(spark):
    field = grid.all_cells(spark, 9, 8).withColumn("v", F.lit(3.0))
    for out in (grid.tpi_box(field, "v", 3), grid.tpi_disk(field, "v", 2)):
        assert out.agg(F.max(F.abs("tpi"))).first()[0] == pytest.approx(0.0)


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x, fold = rng.normal(size=(60, 2)), rng.integers(0, 3, 60)
    y = np.expm1(0.5 + 0.1 * np.clip(x @ [1.0, -0.5], -3, 3))
    df = spark.createDataFrame([(float(a), float(b), float(v), int(f)) for (a, b), v, f in zip(x, y, fold)], "a double, b double, bap double, fold int")
    coef = {r["fold"]: r["coef"] for r in linear.ridge_folds(df.withColumns({"__y": F.log1p("bap"), "w": X.sample_weight("bap")}), ["a", "b"], "__y", "w", "fold").collect()}
    for k in range(3):
        t = fold != k
        z, w, ly = (x[t] - x[t].mean(0)) / x[t].std(0), 1 / (y[t] + 0.5), np.log1p(y[t])
        zc, yc = z - np.average(z, axis=0, weights=w), ly - np.average(ly, weights=w)
        slope = np.linalg.solve((zc * w[:, None]).T @ zc + np.eye(2), (zc * w[:, None]).T @ yc) / x[t].std(0)
        assert coef[k][1:] == pytest.approx(list(slope))


def test_monotone_trees_keep_their_direction_and_learn(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, 2))
    y = 1 + 3 * x[:, 0] + rng.normal(0, 0.5, 400).clip(-1, 1)
    df = spark.createDataFrame([(float(a), float(b) if b > 0.1 else None, float(v)) for (a, b), v in zip(x, y)], "a double, b double, bap double")
    model = boost.fit_monotone(df, ["a", "b"], directions={"a": 1}, trees=6)
    sweep = spark.createDataFrame([(i / 50, 0.5) for i in range(51)], "a double, b double")
    p = [r[0] for r in rows(model.predict(sweep).orderBy("a"), "pred")]
    assert all(u <= v + 1e-12 for u, v in zip(p, p[1:])) and p[-1] > p[0]
    got = model.predict(df).agg(F.avg((F.col("pred") - F.col("bap")) ** 2), F.var_pop("bap")).first()
    assert got[0] < 0.7 * got[1]


def test_feature_sets():
    columns = [c for names in scenarios.GROUPS.values() for c in names]
    sets = scenarios.ladder(columns)
    assert len(sets["M4"]) == 50 and len(sets["V"]) == 39 and scenarios.group_of("pop_log") == "population"


def fold_table(spark, n=400):
    rng = np.random.default_rng(2)
    data = [(k, int(k % 4), float(a), float(b) if k % 9 else None, float(np.exp(a / 2 + rng.normal() / 5))) for k, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame(data, "station_id long, fold int, a double, b double, bap double")


def test_boosting_of_all_folds_equals_a_loop(spark, monkeypatch):
    """The models that are grown together are those that each fold's rows alone would give, cut at the same edges."""
    df = fold_table(spark)
    together = boost.fit_folds(df, ["a", "b"], "fold", directions={"a": 1}, trees=6, depth=2)
    edges = together[0].edges
    keep = boost.bin_columns
    for fold, model in together.items():
        monkeypatch.setattr(boost, "bin_columns", lambda features, _: keep(features, edges))
        alone = boost.fit_monotone(df.where(F.col("fold") != fold), ["a", "b"], directions={"a": 1}, trees=6, depth=2)
        monkeypatch.undo()
        assert alone.base == pytest.approx(model.base)
        for x, y in zip(alone.trees, model.trees, strict=True):
            assert {n: t[:3] for n, t in x.items()} == {n: t[:3] for n, t in y.items()}
            assert [t[3] for t in x.values()] == pytest.approx([t[3] for t in y.values()])


def test_out_of_fold_boosting_keeps_directions_and_learns(spark):
    out = boost.boosted_oof(fold_table(spark), ["a", "b"], "fold", directions={"a": 1}, trees=8, depth=2)
    got = metrics.metrics_by(out.select(F.lit(1).alias("k"), F.col("bap").alias("y"), F.col("boosted").alias("pred")), "k").first()
    assert got["n"] == 400 and got["r2"] > 0.6


def test_every_station_alone_equals_a_loop(spark, monkeypatch):
    """More folds than models of a group: groups of three, margins stored after the fifth tree, one fold without rows of its own."""
    df = fold_table(spark).withColumn("station_id", F.col("station_id") % 8)
    df = df.withColumn("station_id", F.when(F.col("station_id") < 7, F.col("station_id")))  # the others train everywhere
    options = {"directions": {"a": 1}, "trees": 6, "depth": 2, "l1": 0.1}
    monkeypatch.setattr(boost, "MAX_MODELS", 3)
    together = boost.fit_folds(df, ["a", "b"], "station_id", **options)
    assert sorted(together) == list(range(7))
    keep, edges = boost.bin_columns, together[0].edges
    monkeypatch.setattr(boost, "bin_columns", lambda features, _: keep(features, edges))
    alone = {k: boost.fit_monotone(df.where(f"station_id IS NULL OR station_id <> {k}"), ["a", "b"], **options) for k in (0, 6)}
    monkeypatch.undo()
    for k, model in alone.items():
        assert (model.base, model.trees, model.covers, model.splits) == (together[k].base, together[k].trees, together[k].covers, together[k].splits)
    out = boost.predict_folds(df, together, "station_id")
    monkeypatch.setattr(boost, "MAX_NODES", 80)  # models dealt over several expressions
    again = boost.predict_folds(df, together, "station_id")
    key = lambda d: sorted((r["a"], r["pred"]) for r in d.where("station_id IS NOT NULL").collect())
    assert key(out) == key(again) and out.where("station_id IS NULL AND pred IS NULL").count() == again.where("pred IS NULL").count() > 0
    for k, model in alone.items():
        model.edges = edges
        mine = df.where(f"station_id = {k}")
        assert key(out.where(f"station_id = {k}")) == key(model.predict(mine).withColumn("station_id", F.lit(k)))


def test_plans_do_not_grow_with_trees(spark):
    """Eight trees of depth 4 take no larger an expression than one: trees are data of the expression."""
    df = fold_table(spark)
    small, large = (boost.fit_monotone(df, ["a", "b"], directions={}, trees=t, depth=d) for t, d in ((1, 1), (8, 4)))
    length = lambda m: len(m.predict(df)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(length(large) - length(small)) < 40
    assert sum(large.splits.values()) == sum(f >= 0 for t in large.trees for f, *_ in t.values()) > 50


def shapley_by_hand(tree, cover, rate, bins):
    """Shapley values of one row over all subsets of features, by the definition."""
    d = len(bins)

    def value(known, node=1):
        f, cut, missing_left, v = tree[node]
        if f < 0:
            return v
        if f in known:
            left = missing_left if bins[f] < 0 else bins[f] <= cut
            return value(known, 2 * node + (not left))
        a, b = cover[2 * node], cover[2 * node + 1]
        return (a * value(known, 2 * node) + b * value(known, 2 * node + 1)) / (a + b)

    out = [0.0] * d
    for f in range(d):
        others = [k for k in range(d) if k != f]
        for n in range(d):
            for s in itertools.combinations(others, n):
                weight = math.factorial(n) * math.factorial(d - n - 1) / math.factorial(d)
                out[f] += rate * weight * (value({*s, f}) - value(set(s)))
    return out


def test_contributions_are_shapley_values_and_add_up(spark):
    rng = np.random.default_rng(4)
    data = [(*(float(v) if rng.random() > 0.1 else None for v in x), float(np.exp(x[0] - x[1] * x[2] / 2 + x[3] / 9))) for x in rng.normal(size=(300, 4))]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, bap double")
    model = boost.fit_monotone(df, ["a", "b", "c", "d"], directions={"a": 1}, trees=3, depth=4)
    out = model.contributions(model.predict(df)).select("*", model.bins().alias("bins")).collect()
    for r in out:
        assert math.log1p(r["pred"]) == pytest.approx(model.expected() + sum(r["contributions"])) or r["pred"] == 0.0
    for r in out[:40]:
        want = np.sum([shapley_by_hand(t, c, model.rate, r["bins"]) for t, c in zip(model.trees, model.covers, strict=True)], axis=0)
        assert r["contributions"] == pytest.approx(want.tolist())
    mean = np.average([sum(r["contributions"]) for r in out], weights=[1 / (r["bap"] + 0.5) for r in out])
    assert mean == pytest.approx(0.0, abs=1e-6)
    stump = boost.MonotoneModel(["a"], [[]], 0.5, 0.3, [{1: (-1, 0, True, 0.0)}], [{}])
    assert {tuple(r["contributions"]) for r in stump.contributions(df).collect()} == {(0.0,)} and stump.expected() == 0.5


def test_upserts_take_the_last_of_a_batch(spark, tmp_path):
    merge = ingest.upserts_into(f"file://{tmp_path}/t", ["k"], "at", buckets=4)
    for number, rows_ in enumerate(([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "x"), (3, 1, "y")], [(2, 0, "d"), (2, 5, "e"), (9, 1, "z")])):
        merge(spark.createDataFrame(rows_, "k long, at long, v string"), number)
    got = {r["k"]: r["v"] for r in ingest.current(spark, f"file://{tmp_path}/t").collect()}
    assert got == {1: "b", 2: "e", 3: "y", 9: "z"}


def test_nearest_point_on_a_sparse_map(spark):
    cells = spark.createDataFrame([(k, 3 * k % 40) for k in range(40)], "xi long, yi long")
    points = [(1000.0, 500.0), (900_000.0, 10.0), (77_000.0, 81_000.0), (None, 1.0)]
    got = {(r["xi"], r["yi"]): r["dist_km"] for r in grid.nearest_distance(cells, spark.createDataFrame(points, "px double, py double"), "px", "py", tile=1, rings=1).collect()}
    for (x, y), d in got.items():
        assert d == pytest.approx(min(np.hypot(2000 * x - a, 2000 * y - b) for a, b in points if a is not None) / 1000)
    assert len(got) == 40 and grid.nearest_distance(cells, spark.createDataFrame([], "px double, py double"), "px", "py").count() == 0


def test_names_of_columns_and_registry_codes(spark):
    assert tables.clean_columns(spark.createDataFrame([(1, 2)], ["\\2t", "hpbl"])).columns == ["2t", "hpbl"]
    df = spark.createDataFrame([("SK/SPO-SK0004R_05029_100",), ("SPO-SK0004R_00005_100",), ("x_05029_",), (None,)], "p string")
    assert [r[0] for r in df.select(X.registry_code("p")).collect()] == ["SK0004R", None, None, None]


def test_quantiles_equal_numpy_with_small_gaps(spark, monkeypatch):
    """Gaps of more than three rows get nearer bounds; ties, infinities, nulls, NaN and a group without values."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(quantiles, "MAX_ROWS", 3)
    monkeypatch.setattr(quantiles, "ACCURACY", 8)
    groups = {"normal": rng.normal(size=700), "ties": np.round(rng.normal(size=500) * 2), "tail": np.exp(8 * rng.normal(size=400)), "one": np.array([4.5]), "two": np.array([1.0, -np.inf])}
    data = [(k, float(v)) for k, values in groups.items() for v in values] + [("ties", None), ("ties", float("nan")), ("none", None), (None, 2.0), (None, 3.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    probabilities = [0.0, 0.05, 0.333, 0.5, 0.9, 1.0]
    got = quantiles.quantiles(df, "v", probabilities, "g")
    assert set(got) == {*groups, None} and got[None] == pytest.approx([2 + p for p in probabilities])
    for k in ("normal", "ties", "tail", "one"):
        assert got[k] == pytest.approx(np.quantile(groups[k], probabilities).tolist(), rel=1e-12)
    assert got["two"][0] == -np.inf and got["two"][-1] == 1.0
    whole = [v for _, v in data if v is not None and v == v]
    assert quantiles.quantiles(df, "v", [0.25])[""] == pytest.approx([np.quantile(whole, 0.25)])
    assert quantiles.quantiles(df.limit(0), "v", [0.5]) == {}


@pytest.mark.parametrize(("radius", "tile"), [(1, 4), (3, 5), (6, 4), (2, 64)])
def test_tiles_equal_whole_disks(spark, radius, tile):
    rng = np.random.default_rng(3)
    cells = [(x, y, float(rng.normal()) if rng.random() > 0.2 else None) for x in range(17) for y in range(13)]
    field = spark.createDataFrame(cells, "xi int, yi int, v double")
    key = lambda df: {(r["xi"], r["yi"]): r["tpi"] for r in df.collect()}
    got, want = key(grid.tpi_tiles(field, "v", radius, tile)), key(grid.tpi_disk(field, "v", radius))
    assert got.keys() == want.keys()
    for at, v in want.items():
        assert got[at] == (None if v is None else pytest.approx(v, abs=1e-9))


def test_blocks_at_the_edge_take_what_they_have(spark):
    pixels = spark.createDataFrame([(x, y, -9999.0 if x == 4 or (x, y) == (0, 0) else float(10 * x + y)) for x in range(5) for y in range(3)], "px int, py int, e double")
    got = {(r["xi"], r["yi"]): r["e"] for r in grid.block_means(pixels, "e", 2).collect()}
    assert got == {(0, 0): pytest.approx((1 + 10 + 11) / 3), (1, 0): 25.5, (2, 0): None, (0, 1): 7.0, (1, 1): 27.0, (2, 1): None}


def test_late_rows_are_merged_within_the_watermark_and_dropped_beyond(spark, tmp_path):
    """The second of four triggers moves the watermark to day 8; rows are late by it from the fourth on: day 9 counts, day 1 does not."""
    hour = lambda d, h, s, t: (s, dt.datetime(2024, 1, d, h), t, 1.0, 2.0, 100.0 + h, 0.5, -3.0)
    files = [[hour(1, h, 1, 270.0 + h) for h in range(6)], [hour(10, 3, 1, 280.0), hour(9, 2, 2, 281.0)], [hour(10, 4, 1, 282.0)], [hour(9, 5, 2, 290.0), hour(1, 9, 1, 300.0)]]
    schema = "station_id long, time timestamp, t2m double, u10 double, v10 double, hpbl double, rain double, sshf double"
    for k, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    save = ingest.upserts_into(f"file://{tmp_path}/out", ["station_id", "datum"], "n", buckets=4)
    query = ingest.stream_daily(stream).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["station_id"], str(r["datum"])): r for r in ingest.current(spark, f"file://{tmp_path}/out").collect()}
    in_time = [r for part in files for r in part if (r[0], r[1].day, r[1].hour) != (1, 1, 9)]
    want = {(r["station_id"], str(r["datum"])): r for r in daily.daily_features(spark.createDataFrame(in_time, schema)).collect()}
    assert got.keys() == want.keys() and got[2, "2024-01-09"]["n"] == 2 and ingest.dropped(query) > 0
    for k, r in want.items():
        for c in r.asDict():
            assert got[k][c] == (pytest.approx(r[c]) if isinstance(r[c], float) else r[c]), c


def test_a_killed_batch_shows_nothing_and_old_versions_go(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    merge = ingest.upserts_into(path, ["k"], "at", buckets=4)
    batch = lambda *rows_: spark.createDataFrame(list(rows_), "k long, at long, v string")
    seen = lambda: {r["k"]: r["v"] for r in ingest.current(spark, path).collect()}
    assert ingest.current(spark, path) is None
    merge(batch(*((k, 1, "a") for k in range(20))), 0)
    first = seen()
    with monkeypatch.context() as m:
        m.setattr(ingest.pointers, "put", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            merge(batch((3, 2, "b")), 1)
    assert seen() == first  # the folder is there, no manifest names it
    merge(batch((3, 2, "b")), 1)
    merge(batch((3, 2, "b")), 1)  # the batch runs again
    assert seen() == {**first, 3: "b"} and ingest.manifests(spark, path) == [0, 1]
    for n in range(2, 6):
        merge(batch(*((k, n, f"v{n}") for k in range(0, 20, 2))), n)
    assert seen() == {k: "v5" if k % 2 == 0 else "b" if k == 3 else "a" for k in range(20)}
    assert ingest.manifests(spark, path) == [4, 5]
    named = {(v, b) for n in (5, 6) for b, v in ingest.live(spark, path, n).items()} | {(v, b) for b, v in ingest.live(spark, path).items()}
    there = {(int(f.parent.name[8:]), int(f.name[7:])) for f in (tmp_path / "t").glob("version=*/bucket=*")}
    assert there == named and len(there) <= 8
    merge(batch().limit(0), 6)  # an empty batch changes nothing
    assert len(seen()) == 20


def test_stages_are_published_whole(spark, tmp_path, monkeypatch):
    run = tables.Run(f"file://{tmp_path}")
    table = lambda v: spark.createDataFrame([(1, v), (2, v)], "k int, v int")
    with pytest.raises(ValueError):
        run.open(spark, "v4")
    run.publish(table(1), "v4")
    with monkeypatch.context() as m:
        m.setattr(tables.pointers, "put", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            run.publish(table(2), "v4")
    assert {r["v"] for r in run.open(spark, "v4").collect()} == {1}
    for v in (3, 4, 5):
        run.publish(table(v), "v4")
    assert {r["v"] for r in run.open(spark, "v4").collect()} == {5}
    assert sorted(p.name for p in (tmp_path / "runs/default/stages/v4").iterdir() if not p.name.startswith(".")) == ["data-2", "data-3", "live-2", "live-3"]
    run.extend(spark, "v4", "v5", spark.createDataFrame([(1, 9.5)], "k int, w double"), ["k"])
    assert sorted(map(tuple, run.open(spark, "v5").collect())) == [(1, 5, 9.5), (2, 5, None)]


def test_chunks_of_a_cube(spark):
    """Odd sizes, nodes without values, two stations at one node, one outside; dates from the attribute or the file's name."""
    rng = np.random.default_rng(6)
    cube = [(f, b, h, y, x, float(rng.normal())) for f, b in (("m_20240105.nc", None), ("any.nc", "2024-02-01")) for h in range(3) for y in range(5) for x in range(7) if rng.random() < 0.7]
    long = spark.createDataFrame(cube, "file string, base string, h int, y int, x int, t double")
    stations = [("a", 0, 0), ("b", 6, 4), ("c", 6, 4), ("out", 40, 1)]
    chunks = tables.chunked_cube(long, ["file", "base"], ["t"], hours=3, size=(2, 3))
    assert {r[0] for r in chunks.select(F.size("t")).collect()} == {18}
    got = tables.read_chunks(chunks, spark.createDataFrame(stations, "eoi string, x int, y int"), ["t"], hours=3, size=(2, 3))
    day = {"m_20240105.nc": dt.datetime(2024, 1, 5), "any.nc": dt.datetime(2024, 2, 1)}
    want = [(e, day[f] + dt.timedelta(hours=h), t) for e, sx, sy in stations for f, _, h, y, x, t in cube if (x, y) == (sx, sy)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_read_csv_and_verified_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,NaN\n2,2.5\n3,\n")
    assert sorted((r["k"], r["v"]) for r in tables.read_csv(spark, f"file://{tmp_path}/a.csv", "k int, v double").collect()) == [(1, None), (2, 2.5), (3, None)]
    names = tables.VERIFIED_COLUMNS
    spark.createDataFrame([("SPO-1", "2024-01-01", "1.5", 1, 1, "day", "big")], ", ".join(f"{c} {'int' if c.startswith('V') and c != 'Value' else 'string'}" for c in (*names, "Extra"))).write.parquet(f"{tmp_path}/v")
    got = tables.read_verified(spark, [f"file://{tmp_path}/v"])
    assert got.columns == list(names) and "Extra" not in got._jdf.queryExecution().executedPlan().toString()
    cube = spark.createDataFrame([(0, 1, 5.0), (3, 1, 6.0)], "x int, y int, v double")
    assert tables.read_met_cube(cube, spark.createDataFrame([("s", 3, 1)], "eoi string, x int, y int")).first().asDict() == {"eoi": "s", "v": 6.0}
