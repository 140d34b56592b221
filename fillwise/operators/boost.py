"""Boosted trees: MLlib's learner, and a histogram learner for all folds with monotone directions.

The histogram learner reads a table of binned rows once for each level of a tree. A task adds up its rows' gradients by
(model, node, feature, bin) for every model that trains on them; Spark adds up what the tasks found, and the driver, to
which only these sums come, chooses the splits of all models together. A row is read once for all models.

Where there are many folds, most models have the same splits and differ in their values only. Sums are then taken once
for each structure of trees, split by the leaves of earlier trees, so that any model's gradients follow from them and its
values; a model is that less what its own fold's rows add, and the task that reads the fold's rows chooses its splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwise.functions import scalar as X
from fillwise.scratch import stored

# Fixed values of the study: directions in which the prediction may only rise (1) or fall (-1).
DIRECTIONS = {
    "traffic_load_log": 1, "traffic_hdv_log": 1, "dist_major_road_km": -1, "emis_bap_log": 1, "emis_pm25_log": 1, "altitude": -1,
}


def fit_boosted(df: DataFrame, features: list[str], y: str = "bap", offset: float | None = X.WEIGHT_OFFSET, trees: int = 20, depth: int = 6, rate: float = 0.1, seed: int = 42):
    """A PipelineModel that predicts ln(1 + y) from weighted rows; missing values become medians."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = df.where(F.col(y).isNotNull()).withColumns({"__y": F.log1p(y), "__w": X.sample_weight(y, offset), **{c: F.col(c).cast("double") for c in features}})
    filled = [f"__{c}" for c in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="__x"),
        GBTRegressor(featuresCol="__x", labelCol="__y", weightCol="__w", predictionCol="__p", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed),
    ]
    return Pipeline(stages=stages).fit(rows)


def predict(model, df: DataFrame, features: list[str], name: str = "pred") -> DataFrame:
    """Adds the prediction, back from ln(1 + y) and never below 0."""
    out = model.transform(df.withColumns({c: F.col(c).cast("double") for c in features}))
    return out.withColumn(name, X.expm1_clipped("__p")).drop("__x", "__p", *[f"__{c}" for c in features])


def importances(model, features: list[str]) -> dict[str, float]:
    """Share of the gain by feature; features that no tree uses have 0."""
    return dict(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True))


@dataclass
class MonotoneModel:
    """Trees as (feature, bin, missing goes left, value) by node; leaves have feature -1. ``covers`` has the weight of each node's rows.

    ``gains`` and ``splits`` have the sum of the gains and the number of the splits of each feature that any split uses.
    """

    features: list[str]
    edges: list[list[float]]
    base: float
    rate: float
    trees: list[dict[int, tuple[int, int, bool, float]]] = field(default_factory=list)
    covers: list[dict[int, float]] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)
    splits: dict[str, int] = field(default_factory=dict)

    def bins(self) -> Column:
        return bin_columns(self.features, self.edges)

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        return df.withColumn(name, _back(_margins([self])(self.bins(), F.lit(0))))

    def expected(self) -> float:
        """The mean margin of the training rows: what the contributions of a row are added to."""
        return self.base + self.rate * sum(_mean(t, c, 1) for t, c in zip(self.trees, self.covers, strict=True))

    def contributions(self, df: DataFrame, name: str = "contributions") -> DataFrame:
        """Adds an array with the Shapley value of each feature: with ``expected`` they add up to the row's margin, ln(1 + prediction).

        The game is that of the trees: where a split's feature is not known, a row goes both ways by the covers. A leaf asks
        for the features on its path only, so a table of its values for every pattern of fulfilled conditions is made once,
        and a row looks up the pattern that it has.
        """
        leaves = [leaf for t, c in zip(self.trees, self.covers, strict=True) for leaf in _leaf_tables(t, c, self.rate)]
        width = len(self.features)

        @F.arrow_udf("array<double>")
        def shapley(bins: pa.Array) -> pa.Array:
            b = bins.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            out = np.zeros((len(b), width))
            for asked, table in leaves:
                pattern = np.zeros(len(b), np.int64)
                for k, (f, tests) in enumerate(asked):
                    fits = np.ones(len(b), bool)
                    for cut, missing_left, left in tests:
                        fits &= np.where(b[:, f] < 0, missing_left, b[:, f] <= cut) == left
                    pattern += fits << k
                out[:, [f for f, _ in asked]] += table[pattern]
            return pa.ListArray.from_arrays(np.arange(0, out.size + 1, max(width, 1), dtype=np.int32), out.reshape(-1))

        return df.withColumn(name, shapley(self.bins()))


def bin_columns(features: list[str], edges: list[list[float]]) -> Column:
    """Array of the features' bins: the number of edges below the value; -1 where it is missing. NaN is above all edges."""
    cuts = [np.array(e, float) for e in edges]

    @F.arrow_udf("array<short>")
    def bins(values: pa.Array) -> pa.Array:
        flat = values.flatten()
        v = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)
        out = np.column_stack([np.searchsorted(c, v[:, k]) for k, c in enumerate(cuts)]).astype(np.int16)
        out[flat.is_null().to_numpy(zero_copy_only=False).reshape(v.shape)] = -1
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(cuts), dtype=np.int32), out.reshape(-1))

    return bins(F.array(*[F.col(c).cast("double") for c in features]))


def _mean(tree: dict, cover: dict, node: int) -> float:
    """Mean value of the leaves under a node, by their covers."""
    if tree[node][0] < 0:
        return tree[node][3]
    a, b = cover[2 * node], cover[2 * node + 1]
    return (a * _mean(tree, cover, 2 * node) + b * _mean(tree, cover, 2 * node + 1)) / (a + b)


def _leaf_tables(tree: dict, cover: dict, rate: float):
    """For each leaf but a lone root: [(feature, [(cut, missing left, goes left)])] of its path, and its Shapley values by pattern.

    Bit k of a pattern says that a row fulfils what the path asks of the k-th feature.
    """
    for node in (n for n, t in tree.items() if t[0] < 0 and n > 1):
        tests: dict = {}
        share: dict = {}
        at = node
        while at > 1:
            f, cut, missing_left, _ = tree[at // 2]
            tests.setdefault(f, []).append((cut, missing_left, at % 2 == 0))
            share[f] = share.get(f, 1.0) * cover[at] / (cover[at - at % 2] + cover[at - at % 2 + 1])
            at //= 2
        d, shares = len(tests), list(share.values())
        subsets = list(product((0, 1), repeat=d))  # by bits, the first feature last
        number = [sum(bit << k for k, bit in enumerate(s)) for s in subsets]
        others = np.array([np.prod([q for q, bit in zip(shares, s, strict=True) if not bit]) for s in subsets])
        fulfilled = np.array([[all(p >= q for p, q in zip(pattern, s, strict=True)) for s in subsets] for pattern in subsets])
        weight = np.array([[(1 if s[k] else -1) / (d * comb(d - 1, sum(s) - s[k])) for k in range(d)] for s in subsets])
        table = np.zeros((1 << d, d))
        table[number] = rate * tree[node][3] * ((fulfilled * others) @ weight)
        yield list(tests.items()), table


@dataclass
class Packed:
    """Trees of some models as arrays (model, tree, node)."""

    feature: np.ndarray
    cut: np.ndarray
    missing: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, trees: list[list[dict]]) -> Packed:
        size = 1 + max((n for model in trees for t in model for n in t), default=1)
        shape = (len(trees), max((len(m) for m in trees), default=0), size)
        out = cls(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape, bool), np.zeros(shape))
        for m, model in enumerate(trees):
            for t, tree in enumerate(model):
                nodes = list(tree)
                f, cut, missing, value = zip(*tree.values(), strict=True)
                out.feature[m, t, nodes], out.cut[m, t, nodes], out.missing[m, t, nodes], out.value[m, t, nodes] = f, cut, missing, value
        return out

    def some(self, models) -> Packed:
        return Packed(self.feature[models], self.cut[models], self.missing[models], self.value[models])

    def leaf(self, bins: np.ndarray, model, tree: int) -> np.ndarray:
        """The leaf of each row, by one model or by each row's own."""
        at = np.arange(len(bins))
        node = np.ones(len(bins), np.int64)
        flat, width = bins.reshape(-1), bins.shape[1]
        while True:
            f = self.feature[model, tree, node]
            if not (inner := f >= 0).any():
                return node
            b = flat[at * width + np.maximum(f, 0)]
            left = np.where(b < 0, self.missing[model, tree, node], b <= self.cut[model, tree, node])
            node = np.where(inner, 2 * node + ~left, node)


class Forest(Mapping):
    """Models by fold as arrays (model, tree, node), for very many of them; a MonotoneModel is made when it is asked for."""

    def __init__(self, features: list[str], edges: list[list[float]], bases: dict, rate: float, trees: int, depth: int):
        shape = (len(bases), trees, 2 ** (depth + 1))
        self.features, self.edges, self.rate, self.keys_, self.base = features, edges, rate, {k: n for n, k in enumerate(bases)}, np.array(list(bases.values()))
        self.packed = Packed(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape, bool), np.zeros(shape))
        self.cover, self.gain, self.node = np.zeros(shape), np.zeros(shape), np.zeros(shape, bool)
        self.node[:, :, 1] = True

    def __iter__(self):
        return iter(self.keys_)

    def __len__(self) -> int:
        return len(self.keys_)

    def __getitem__(self, fold) -> MonotoneModel:
        m, p = self.keys_[fold], self.packed
        out = MonotoneModel(self.features, self.edges, float(self.base[m]), self.rate)
        for t in range(p.feature.shape[1]):
            nodes = np.flatnonzero(self.node[m, t]).tolist()
            inner = [n for n in nodes if p.feature[m, t, n] >= 0]
            out.trees.append({n: (int(p.feature[m, t, n]), int(p.cut[m, t, n]), bool(p.missing[m, t, n]), 0.0) if n in inner else (-1, 0, True, float(p.value[m, t, n])) for n in nodes})
            out.covers.append({n: float(self.cover[m, t, n]) for n in nodes} if inner else {})
            for n in inner:
                name = self.features[p.feature[m, t, n]]
                out.gains[name] = out.gains.get(name, 0.0) + float(self.gain[m, t, n])
                out.splits[name] = out.splits.get(name, 0) + 1
        return out


def _margins(models: list[MonotoneModel] | Forest, lo: int = 0, hi: int | None = None):
    """A function of (bins, number of the model) columns: the margin by the row's own of models ``lo`` to ``hi``, null without one."""
    if isinstance(models, Forest):
        packed, base = models.packed.some(slice(lo, hi)), models.base[lo:hi]
        rate, width = models.rate, len(models.features)
    else:
        packed, base = Packed.of([m.trees for m in models[lo:hi]]), np.array([m.base for m in models[lo:hi]])
        rate, width = models[0].rate, len(models[0].features)

    @F.arrow_udf("double")
    def margin(bins: pa.Array, number: pa.Array) -> pa.Array:
        b = bins.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        own = number.fill_null(-1).to_numpy(zero_copy_only=False)
        m = np.maximum(own, 0)
        out = base[m]
        for t in range(packed.feature.shape[1]):
            out = out + rate * packed.value[m, t, packed.leaf(b, m, t)]
        return pa.array(out, mask=own < 0)

    return margin


def _back(margin: Column) -> Column:
    return F.when(margin.isNotNull(), X.expm1_clipped(margin))


#: Gradients are whole numbers of 1 / UNIT, so that their sums do not depend on the order, and siblings' sums subtract exactly.
UNIT = float(1 << 26)
#: Sums of a pass that come to the driver (models x nodes x features x bins): models are fitted in groups that keep below.
MAX_SUMS = 500_000
#: Models of a group whose margins are stored with the rows, and trees between two storings.
MAX_MODELS, STORE_EACH = 128, 5
#: From so many models on sums are taken by structure; rows of a fold that a task takes at once, and models whose splits it chooses at once.
MIN_SHARED, ROWS_EACH, CHOSEN_EACH = 16, 100_000, 64


@dataclass
class Binned:
    """Training rows (own, y, w, b) as a stored table: the number of the row's fold, the target, the weight, the bins of the features.

    ``bases`` has the mean of the target outside each fold; without folds, that of all rows under None. ``counts`` has the
    rows of each fold. Of many folds each has its rows side by side.
    """

    rows: DataFrame
    features: list[str]
    edges: list[list[float]]
    bases: dict
    counts: dict


def binned(df: DataFrame, features: list[str], fold: str | None = None, y: str = "bap", n_bins: int = 16, offset: float | None = X.WEIGHT_OFFSET) -> Binned:
    """Rows with a target, ready for models on any of the features. Features are cut at quantiles of all rows."""
    rows = df.where(F.col(y).isNotNull()).withColumns({"__y": F.log1p(y), "__w": X.sample_weight(y, offset)})
    rows = rows.withColumn("__fold", F.col(fold) if fold else F.lit(None).cast("int"))
    rows = stored(rows.select("__fold", "__y", "__w", *[F.col(c).cast("double").alias(c) for c in features]), "training")
    cuts = [i / n_bins for i in range(1, n_bins)]
    got = rows.agg(*[F.percentile_approx(c, cuts, 10_000).alias(c) for c in features]).first()
    edges = [sorted(set(got[c] or [])) for c in features]
    unit = lambda c: F.sum(F.round(c * UNIT).cast("long"))
    sums = rows.groupBy("__fold").agg(unit(F.col("__w") * F.col("__y")).alias("wy"), unit(F.col("__w")).alias("w"), F.count("*").alias("n")).collect()
    sums.sort(key=lambda r: (r["__fold"] is not None, r["__fold"]))
    whole, bases, counts = [sum(r["wy"] for r in sums), sum(r["w"] for r in sums)], {}, {}
    for r in sums:
        if fold and r["__fold"] is None:
            continue
        left = (whole[0] - r["wy"], whole[1] - r["w"]) if fold else whole
        if left[1] > 0:
            bases[r["__fold"]], counts[r["__fold"]] = float(left[0] / left[1]), r["n"]
    rows = numbered(rows, "__fold", list(bases)) if fold and bases else rows.withColumn("__m", F.lit(-1))
    if fold and len(bases) >= MIN_SHARED:  # large folds, and rows without one, in pieces
        large = {k: -(-n // ROWS_EACH) for k, n in enumerate(counts.values()) if n > ROWS_EACH}
        pieces = F.when(F.col("__m").isNull(), F.lit(1 << 20))
        pieces = pieces.otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in large.items() for x in pair]), "__m"), F.lit(1))) if large else pieces.otherwise(F.lit(1))
        rows = rows.withColumn("__piece", F.pmod(F.monotonically_increasing_id(), pieces))
        parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-sum(r["n"] for r in sums) // (10 * ROWS_EACH)))
        rows = rows.repartition(parts, "__m", "__piece").sortWithinPartitions("__m")
    rows = rows.select(F.coalesce("__m", F.lit(-1)).alias("own"), F.col("__y").alias("y"), F.col("__w").alias("w"), bin_columns(features, edges).alias("b"))
    return Binned(stored(rows, "binned"), list(features), edges, bases, counts)


def fit_binned(
    data: Binned, features: list[str] | None = None, directions: dict[str, int] | None = None, trees: int = 10, depth: int = 3, rate: float = 0.3,
    l2: float = 1.2, l1: float = 0.0,
) -> dict:
    """{fold: MonotoneModel} of the models that leave each fold out, on some of the features; see fit_folds."""
    features = data.features if features is None else features
    directions = {c: d for c, d in (DIRECTIONS if directions is None else directions).items() if c in features}
    columns = [data.features.index(c) for c in features]
    edges = [data.edges[k] for k in columns]
    turns = np.array([directions.get(c, 0) for c in features])
    width = 2 + max(map(len, edges))
    if len(data.bases) >= MIN_SHARED and trees and depth and (1 + 2**depth * trees) * 2 ** (depth - 1) * len(features) * width <= MAX_SUMS:
        return _Shared(data, features, edges, np.array(columns), turns, trees, depth, rate, l1, l2).grow()
    models = {fold: MonotoneModel(features, edges, base, rate) for fold, base in data.bases.items()}
    each = max(1, MAX_SUMS // (2 ** max(0, depth - 2) * len(features) * (2 + max(map(len, edges)))))
    each = min(each, MAX_MODELS) if trees > STORE_EACH else each
    numbers = list(enumerate(models.values()))
    for lo in range(0, len(numbers), each):
        _Group(data.rows, numbers[lo : lo + each], np.array(columns), turns, depth, l1, l2).grow(trees)
    return models


def fit_folds(
    df: DataFrame, features: list[str], fold: str | None = None, y: str = "bap", directions: dict[str, int] | None = None, trees: int = 10,
    depth: int = 3, rate: float = 0.3, n_bins: int = 16, l2: float = 1.2, offset: float | None = X.WEIGHT_OFFSET, l1: float = 0.0,
) -> dict:
    """{fold: MonotoneModel} of the models that leave each fold out; without ``fold`` {None: model}.

    Boosted trees on ln(1 + y) whose predictions keep the given directions. A split on a directed feature bounds its
    children at the middle of their values. Any number of folds, each station alone too: they are fitted in groups whose
    sums stay below MAX_SUMS. Of two siblings only the lighter is added up, the other is what their parent has more.
    Margins are stored with the rows every STORE_EACH trees, so that work grows in proportion to the trees. Rows of a null
    fold train all models; without rows there is no model. From MIN_SHARED folds on, sums are taken for each structure of
    trees and not for each model, unless the trees are too many for that; values then differ by rounding alone.
    """
    return fit_binned(binned(df, features, fold, y, n_bins, offset), features, directions, trees, depth, rate, l2, l1)


def numbered(df: DataFrame, fold: str, keys: list) -> DataFrame:
    """Adds ``__m``, the place of the row's fold among the keys; null for other folds. There are as many keys as models on the driver."""
    kind = df.schema[fold].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(key, k) for k, key in enumerate(keys)], f"__key {kind}, __m int")
    return df.join(F.broadcast(table), F.col(fold) == F.col("__key"), "left").drop("__key")


def _lefts(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (..., feature, bin) as those left of each cut (..., feature, missing left or not, cut), and the whole (...), in whole numbers."""
    side = np.array([1, 0], sums.dtype)[:, None]
    return np.cumsum(sums[..., 1:], axis=-1)[..., None, :-1] + side * sums[..., :1, None], sums[..., 0, :].sum(axis=-1)


def _gains(cg, ch, total_g, total_h, low, high, alive, cuts: np.ndarray, directions: np.ndarray, l1: float, l2: float):
    """(gain by (model, node, cut of any feature), allowed splits, left and right values, left and right weights, weight of the node) from sums of 1 / UNIT."""
    cg, ch, total_g, total_h = (a / UNIT for a in (cg, ch, total_g, total_h))
    lo, hi = low[..., None, None, None], high[..., None, None, None]
    rg, rh = total_g[..., None, None, None] - cg, total_h[..., None, None, None] - ch
    soft = lambda a: np.sign(a) * np.maximum(np.abs(a) - l1, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        lv, rv = (np.clip(soft(a) / (b + l2), lo, hi) for a, b in ((cg, ch), (rg, rh)))
        root = np.clip(soft(total_g) / (total_h + l2), low, high)
    worth = lambda v, a, b: 2 * v * a - v * v * (b + l2) - 2 * l1 * np.abs(v)
    gain = worth(lv, cg, ch) + worth(rv, rg, rh) - worth(root, total_g, total_h)[..., None, None, None]
    ok = (ch > 1e-6) & (rh > 1e-6) & (np.arange(ch.shape[-1]) < cuts[:, None, None]) & alive[..., None, None, None]
    ok &= (rv - lv) * directions[:, None, None] >= 0
    return np.where(ok, gain, -np.inf).reshape(*alive.shape, -1), ok, lv, rv, ch, rh, total_h


class _Group:
    """Models that grow together over one table of binned rows (own, y, w, b)."""

    def __init__(self, rows: DataFrame, models: list[tuple[int, MonotoneModel]], columns: np.ndarray, directions: np.ndarray, depth: int, l1: float, l2: float):
        self.rows, self.numbers, self.models = rows, np.array([k for k, _ in models]), [m for _, m in models]
        self.columns, self.directions, self.depth, self.l1, self.l2 = columns, directions, depth, l1, l2
        self.features, self.cuts = self.models[0].features, np.array([len(e) for e in self.models[0].edges])
        self.width = int(self.cuts.max()) + 2  # missing, and one bin more than cuts
        self.stored = 0  # trees that the column p holds

    def grow(self, trees: int) -> None:
        for t in range(trees):
            if t - self.stored == STORE_EACH:
                self.rows, self.stored = stored(self.rows.mapInArrow(self._hold(), "own int, y double, w double, b array<short>, p array<double>"), "margins"), t
            for m in self.models:
                m.trees.append({1: (-1, 0, True, 0.0)})
                m.covers.append({})
            n = len(self.models)
            low, high, alive = np.full((n, 1), -np.inf), np.full((n, 1), np.inf), np.ones((n, 1), bool)
            sums = None
            for level in range(self.depth):
                sums = self._sums(level, alive, sums)
                low, high, alive = self._split(level, sums, low, high, alive)
                if not alive.any():
                    break

    def _reader(self):
        """A function that gives (bins, y, w, own, function of a model for its margins) of a batch of rows."""
        packed = Packed.of([m.trees[self.stored : len(m.trees)] for m in self.models])
        base, rate, held, columns = np.array([m.base for m in self.models]), self.models[0].rate, self.stored, self.columns

        def read(batch: pa.RecordBatch, trees: int):
            own, y, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            bins = np.ascontiguousarray(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)[:, columns])
            before = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1) if held else None

            def margin(m: int) -> np.ndarray:
                p = before[:, m] if held else np.full(len(y), base[m])
                for t in range(trees):
                    p = p + rate * packed.value[m, t, packed.leaf(bins, m, t)]
                return p

            return bins, y, w, own, margin

        return packed, read

    def _hold(self):
        _, read = self._reader()
        trees, n = len(self.models[0].trees) - self.stored, len(self.models)

        def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, y, _, _, margin = read(batch, trees)
                p = np.column_stack([margin(m) for m in range(n)])
                p = pa.ListArray.from_arrays(np.arange(0, p.size + 1, n, dtype=np.int32), p.reshape(-1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], p], ["own", "y", "w", "b", "p"])

        return hold

    def _sums(self, level: int, alive: np.ndarray, parents: np.ndarray | None) -> np.ndarray:
        """(models, nodes of the level, features, bins, 2): gradients and weights in whole numbers of 1 / UNIT."""
        n, nodes = alive.shape
        build = alive.copy()
        if level:  # of siblings the lighter one
            covers = np.array([[m.covers[-1].get(nodes + k, 0.0) for k in range(nodes)] for m in self.models])
            left = covers[:, 0::2] <= covers[:, 1::2]
            build[:, 0::2] &= left
            build[:, 1::2] &= ~left
        slot = np.full((n, nodes), -1)
        slot[build] = np.arange(build.sum()) - np.repeat(np.concatenate([[0], np.cumsum(build.sum(axis=1))[:-1]]), build.sum(axis=1))
        packed, read = self._reader()
        trees, width, features, slots, numbers = len(self.models[0].trees) - self.stored - 1, self.width, len(self.features), int(slot.max()) + 1, self.numbers
        shape = (n, slots, features, width)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, n, slots * features * width))
            for batch in batches:
                bins, y, w, own, margin = read(batch, trees)
                place = bins + np.int64(1) + np.arange(features) * width
                h = np.rint(w * UNIT)
                for m in range(n):
                    at = packed.leaf(bins, m, trees) - nodes if level else np.zeros(len(y), np.int64)
                    at = np.where(at >= 0, slot[m, at], -1)  # rows of a leaf higher up are in no node of the level
                    use = np.flatnonzero((at >= 0) & (own != numbers[m]))
                    if not len(use):
                        continue
                    g = np.rint(w[use] * (y[use] - margin(m)[use]) * UNIT)
                    cell = (place[use] + (at[use] * (features * width))[:, None]).T
                    for f in range(features):
                        total[0, m] += np.bincount(cell[f], g, minlength=total.shape[2])
                        total[1, m] += np.bincount(cell[f], h[use], minlength=total.shape[2])
            g, h = total.reshape(2, -1)
            cells = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(g[cells].astype(np.int64)), pa.array(h[cells].astype(np.int64))], ["cell", "g", "h"])

        got = self.rows.mapInArrow(add, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        found = np.zeros((int(np.prod(shape)), 2), np.int64)
        found[got["cell"].to_numpy()] = np.column_stack([got["g"].to_numpy(), got["h"].to_numpy()])
        found = found.reshape(*shape, 2)
        out = np.zeros((n, nodes, features, width, 2), np.int64)
        m, node = np.nonzero(build)
        out[m, node] = found[m, slot[m, node]]
        if level:
            m, node = np.nonzero(alive & ~build)
            out[m, node] = parents[m, node // 2] - out[m, node ^ 1]
        return out

    def _split(self, level: int, sums: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray):
        """Splits the nodes of a level; (lower bounds, upper bounds, whether there is such a node) of the next one."""
        n, nodes = alive.shape
        (cg, total_g), (ch, total_h) = (_lefts(sums[..., k]) for k in (0, 1))
        gain, ok, lv, rv, ch, rh, total_h = _gains(cg, ch, total_g, total_h, low, high, alive, self.cuts, self.directions, self.l1, self.l2)
        below = np.zeros((n, 2 * nodes), bool)
        lows, highs = np.repeat(low, 2, axis=1), np.repeat(high, 2, axis=1)
        if not gain.shape[-1]:
            return lows, highs, below
        best = gain.argmax(axis=-1)
        for m, k in np.argwhere(np.take_along_axis(gain, best[..., None], -1)[..., 0] > 1e-9):
            f, side_at, cut = np.unravel_index(best[m, k], ok.shape[2:])
            at, model, node = (m, k, f, side_at, cut), self.models[m], nodes + int(k)
            name, left, right = self.features[f], float(lv[at]), float(rv[at])
            model.gains[name] = model.gains.get(name, 0.0) + float(gain[m, k, best[m, k]])
            model.splits[name] = model.splits.get(name, 0) + 1
            model.trees[-1][node] = (int(f), int(cut), not side_at, 0.0)
            model.covers[-1][1] = model.covers[-1].get(1, float(total_h[m, k]))
            for child, value, cover in ((2 * node, left, ch[at]), (2 * node + 1, right, rh[at])):
                model.trees[-1][child], model.covers[-1][child] = (-1, 0, True, value), float(cover)
            below[m, 2 * k : 2 * k + 2] = True
            mid, d = (left + right) / 2, self.directions[f]
            if d > 0:
                highs[m, 2 * k], lows[m, 2 * k + 1] = mid, mid
            elif d < 0:
                lows[m, 2 * k], highs[m, 2 * k + 1] = mid, mid
        return lows, highs, below


class _Shared:
    """Models of many folds over one table of binned rows (own, y, w, b), by the structures that their trees have in common."""

    def __init__(self, data: Binned, features: list[str], edges: list, columns: np.ndarray, directions: np.ndarray, trees: int, depth: int, rate: float, l1: float, l2: float):
        self.rows, self.columns, self.directions, self.depth, self.l1, self.l2 = data.rows, columns, directions, depth, l1, l2
        self.forest = Forest(features, edges, data.bases, rate, trees, depth)
        self.counts, self.cuts = np.array(list(data.counts.values())), np.array([len(e) for e in edges])
        self.width = int(self.cuts.max()) + 2

    def grow(self) -> Forest:
        forest, p = self.forest, self.forest.packed
        for t in range(p.feature.shape[1]):
            n = len(forest)
            low, high, alive = np.full((n, 1), -np.inf), np.full((n, 1), np.inf), np.ones((n, 1), bool)
            for level in range(self.depth):
                kinds = np.concatenate([p.feature[:, : t + 1], p.cut[:, : t + 1], p.missing[:, : t + 1]], axis=1, dtype=np.int16).reshape(n, -1)
                _, first, kind = np.unique(np.ascontiguousarray(kinds).view(np.dtype((np.void, 2 * kinds.shape[1]))).ravel(), return_index=True, return_inverse=True)
                planes = 1 + max(1, t * 2**self.depth)
                each = max(1, MAX_SUMS // (planes * 2**level * len(forest.features) * self.width))
                parts = []
                for lo in range(0, len(first), each):
                    some = np.flatnonzero((kind >= lo) & (kind < lo + each) & alive.any(axis=1))
                    if len(some):
                        parts.append(self._chosen(t, level, first[lo : lo + each], np.where((kind >= lo) & (kind < lo + each), kind - lo, -1), low, high, alive))
                low, high, alive = self._split(t, level, np.concatenate(parts), low, high, alive)
                if not alive.any():
                    break
        return forest

    def _batch(self, batch: pa.RecordBatch):
        own, y, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        return own, y, w, np.ascontiguousarray(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)[:, self.columns])

    def _totals(self, t: int, level: int, packed: Packed, leaves: np.ndarray) -> np.ndarray:
        """(structures, planes, nodes of the level, features, bins) over all rows: w * y, then w, by the leaves of each tree before."""
        nodes, width, features, slots = 2**level, self.width, len(self.forest.features), 2**self.depth
        cells, read, n = nodes * features * width, self._plain()._batch, len(leaves)
        shape = (n, 1 + max(1, t * slots), nodes, features, width)
        slot_of = np.zeros((n, max(1, t), packed.feature.shape[2]), np.int64)
        for s, u, k in np.argwhere(leaves >= 0):
            slot_of[s, u, leaves[s, u, k]] = k

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, shape[1], cells))
            for batch in batches:
                _, y, w, bins = read(batch)
                place = bins + np.int64(1) + np.arange(features) * width
                h, g = np.rint(w * UNIT), np.rint(w * y * UNIT)
                for s in range(n):
                    at = packed.leaf(bins, s, t) - nodes if level else np.zeros(len(y), np.int64)
                    use = np.flatnonzero(at >= 0)
                    if not len(use):
                        continue
                    cell, hs = (place[use] + (at[use] * (features * width))[:, None]).ravel(), np.repeat(h[use], features)
                    total[s, 0] += np.bincount(cell, np.repeat(g[use], features), minlength=cells)
                    if not t:
                        total[s, 1] += np.bincount(cell, hs, minlength=cells)
                    for u in range(t):
                        leaf = slot_of[s, u, packed.leaf(bins[use], s, u)] * cells
                        total[s, 1 + u * slots : 1 + (u + 1) * slots] += np.bincount(cell + np.repeat(leaf, features), hs, minlength=slots * cells).reshape(slots, cells)
            flat = total.reshape(-1)
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some].astype(np.int64))], ["cell", "v"])

        got = self.rows.mapInArrow(add, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(int(np.prod(shape)), np.int64)
        out[got["cell"].to_numpy()] = got["v"].to_numpy()
        return out.reshape(shape)

    def _plain(self) -> _Shared:
        """What tasks need of this object."""
        out = object.__new__(_Shared)
        out.columns, out.directions, out.cuts, out.width, out.l1, out.l2 = self.columns, self.directions, self.cuts, self.width, self.l1, self.l2
        return out

    def _chosen(self, t: int, level: int, first: np.ndarray, kind: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Splits (model, node of the level, feature, missing left, cut, gain, left and right value, left and right weight, weight) of the models of some structures.

        ``first`` has a model of each structure, ``kind`` the structure of each model or -1.
        """
        forest, slots, nodes = self.forest, 2**self.depth, 2**level
        whole = Packed(*(a[:, : t + 1] for a in (forest.packed.feature, forest.packed.cut, forest.packed.missing, forest.packed.value)))
        leaves = np.full((len(first), max(1, t), slots), -1)
        for s, m in enumerate(first):
            for u in range(t):
                found = np.flatnonzero(forest.node[m, u] & (whole.feature[m, u] < 0))
                leaves[s, u, : len(found)] = found
        totals = self._totals(t, level, whole.some(first), leaves)
        lefts, sums = _lefts(totals)
        heavy = slice(1, 1 + slots if t else 2)  # planes that add up to all weights
        lefts_h, sums_h = lefts[:, heavy].sum(axis=1), sums[:, heavy].sum(axis=1)
        base, rate, counts, plain = forest.base, forest.rate, self.counts, self._plain()
        width, features = self.width, len(forest.features)
        cells = nodes * features * width

        def choose(models: np.ndarray, own: np.ndarray) -> np.ndarray:
            """``own`` has (models, 2, nodes, features, bins): what the models' own rows would add."""
            parts = []
            for s in np.unique(kind[models]):
                mine = np.flatnonzero(kind[models] == s)
                m = models[mine]
                margin = base[m][:, None] if not t else np.concatenate([rate * whole.value[m, u][:, np.maximum(leaves[s, u], 0)] + (base[m][:, None] if not u else 0.0) for u in range(t)], axis=1)
                # one plane after the other: equal sums give equal results
                cg, total_g = np.repeat(lefts[s, 0][None].astype(float), len(m), axis=0), np.repeat(sums[s, 0][None].astype(float), len(m), axis=0)
                for k in range(margin.shape[1]):
                    cg -= margin[:, k, None, None, None, None] * lefts[s, 1 + k]
                    total_g -= margin[:, k, None] * sums[s, 1 + k]
                (og, og_total), (oh, oh_total) = (_lefts(own[mine, k]) for k in (0, 1))
                got = _gains(
                    np.rint(cg) - og, lefts_h[s] - oh, np.rint(total_g) - og_total, sums_h[s] - oh_total, low[m], high[m], alive[m], plain.cuts, plain.directions, plain.l1, plain.l2
                )
                gain, ok, lv, rv, ch, rh, total_h = got
                if not gain.shape[-1]:
                    continue
                best = gain.argmax(axis=-1)
                k, node = np.nonzero(np.take_along_axis(gain, best[..., None], -1)[..., 0] > 1e-9)
                f, side, cut = np.unravel_index(best[k, node], ok.shape[2:])
                at = (k, node, f, side, cut)
                parts.append(np.column_stack([m[k], node, f, 1 - side, cut, gain[k, node, best[k, node]], lv[at], rv[at], ch[at], rh[at], total_h[k, node]]))
            return np.concatenate(parts) if parts else np.zeros((0, 11))

        def answer(splits: np.ndarray) -> pa.RecordBatch:
            none = pa.array(np.zeros(len(splits), np.int64))
            values = pa.ListArray.from_arrays(np.arange(0, splits.size + 1, 11, dtype=np.int32), splits.reshape(-1))
            return pa.RecordBatch.from_arrays([pa.array(splits[:, 0].astype(np.int32)), pa.array((-1 - splits[:, 1]).astype(np.int64)), none, none, values], ["m", "cell", "g", "h", "split"])

        def partial(m: int, own: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero(own.reshape(2, -1)[1])
            g, h = own.reshape(2, -1)[:, some].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), m, np.int32)), pa.array(some), pa.array(g), pa.array(h), pa.nulls(len(some), pa.list_(pa.float64()))], ["m", "cell", "g", "h", "split"])

        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None  # the last fold, whose rows may go on: (model, rows, sums)

            def told(models, n, own):
                full = n == counts[models]
                if full.any():
                    yield answer(choose(models[full], own[full]))
                for k in np.flatnonzero(~full):
                    yield partial(int(models[k]), own[k])

            for batch in batches:
                number, y, w, bins = plain._batch(batch)
                use = np.flatnonzero((number >= 0) & (kind[number] >= 0))
                use = use[np.argsort(number[use], kind="stable")]
                models, starts = np.unique(number[use], return_index=True)
                for lo in range(0, len(models), CHOSEN_EACH):
                    some = models[lo : lo + CHOSEN_EACH]
                    r = use[starts[lo] : starts[lo + CHOSEN_EACH] if lo + CHOSEN_EACH < len(models) else None]
                    m, b = number[r], bins[r]
                    p = base[m]
                    for u in range(t):
                        p = p + rate * whole.value[m, u, whole.leaf(b, m, u)]
                    place = np.searchsorted(some, m)
                    n = np.bincount(place, minlength=len(some))
                    at = whole.leaf(b, m, t) - nodes if level else np.zeros(len(r), np.int64)
                    inside = np.flatnonzero(at >= 0)
                    cell = ((place * cells + at * (features * width))[inside, None] + b[inside] + np.int64(1) + np.arange(features) * width).ravel()
                    g, h = np.rint(w[r] * (y[r] - p) * UNIT)[inside], np.rint(w[r] * UNIT)[inside]
                    own = np.stack([np.bincount(cell, np.repeat(v, features), minlength=len(some) * cells).reshape(-1, nodes, features, width) for v in (g, h)], axis=1)
                    if held and held[0] == some[0]:
                        n[0], own[0] = n[0] + held[1], own[0] + held[2]
                    elif held:
                        yield from told(np.array([held[0]]), np.array([held[1]]), held[2][None])
                    yield from told(some[:-1], n[:-1], own[:-1])
                    held = (some[-1], n[-1], own[-1])
            if held:
                yield from told(np.array([held[0]]), np.array([held[1]]), held[2][None])

        out = self.rows.mapInArrow(tasks, "m int, cell long, g long, h long, split array<double>")
        got = out.groupBy("m", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.first("split").alias("split")).toArrow()
        m, cell, g, h = (got[c].to_numpy() for c in ("m", "cell", "g", "h"))
        done = cell < 0
        parts = [got["split"].combine_chunks().filter(pa.array(done)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 11)] if len(m) else []
        # folds whose rows lie in several tasks
        rest, place = np.unique(m[~done], return_inverse=True)
        for lo in range(0, len(rest), CHOSEN_EACH):
            mine = (place >= lo) & (place < lo + CHOSEN_EACH)
            some = rest[lo : lo + CHOSEN_EACH]
            own = np.zeros((len(some), 2, cells))
            own[place[mine] - lo, 0, cell[~done][mine]], own[place[mine] - lo, 1, cell[~done][mine]] = g[~done][mine], h[~done][mine]
            parts.append(choose(some, own.reshape(-1, 2, nodes, features, width)))
        return np.concatenate(parts) if parts else np.zeros((0, 11))

    def _split(self, t: int, level: int, splits: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray):
        """Splits the nodes of a level; (lower bounds, upper bounds, whether there is such a node) of the next one."""
        forest, p, nodes = self.forest, self.forest.packed, 2**level
        m, k, f, missing, cut = splits[:, :5].T.astype(np.int64)
        gain, left, right, ch, rh, total = splits[:, 5:].T
        node = nodes + k
        p.feature[m, t, node], p.cut[m, t, node], p.missing[m, t, node], p.value[m, t, node], forest.gain[m, t, node] = f, cut, missing, 0.0, gain
        if not level:
            forest.cover[m, t, 1] = total
        below = np.zeros((len(forest), 2 * nodes), bool)
        lows, highs = np.repeat(low, 2, axis=1), np.repeat(high, 2, axis=1)
        for side, value, cover in ((0, left, ch), (1, right, rh)):
            child = 2 * node + side
            forest.node[m, t, child], p.value[m, t, child], forest.cover[m, t, child], below[m, 2 * k + side] = True, value, cover, True
        middle, d = (left + right) / 2, self.directions[f]
        for up, bound_left, bound_right in ((d > 0, highs, lows), (d < 0, lows, highs)):
            bound_left[m[up], 2 * k[up]], bound_right[m[up], 2 * k[up] + 1] = middle[up], middle[up]
        return lows, highs, below


def fit_monotone(df: DataFrame, features: list[str], **options) -> MonotoneModel:
    """One model on all rows; see fit_folds."""
    return fit_folds(df, features, **options)[None]


#: Nodes of the models that one expression predicts with; more models are dealt over several.
MAX_NODES = 4_000_000


def predict_folds(df: DataFrame, models: dict, fold: str, name: str = "pred") -> DataFrame:
    """Adds the prediction of each row by the model without its fold; null where there is none."""
    if not models:
        return df.withColumn(name, F.lit(None).cast("double"))
    shared = isinstance(models, Forest)
    all_models = models if shared else list(models.values())
    nodes = (models.packed.feature[0].size if shared else sum(len(t) for t in all_models[0].trees)) or 1
    each = max(1, MAX_NODES // nodes)
    source = models if shared else all_models[0]
    out, bins, kept = numbered(df, fold, list(models)), bin_columns(source.features, source.edges), df.columns
    if len(all_models) <= each:
        return out.withColumn(name, _back(_margins(all_models)(bins, F.col("__m")))).select(*kept, name)
    parts = [out.where(F.col("__m").isNull()).withColumn(name, F.lit(None).cast("double"))]
    for lo in range(0, len(all_models), each):
        some = out.where(F.col("__m").between(lo, lo + each - 1))
        parts.append(some.withColumn(name, _back(_margins(all_models, lo, lo + each)(bins, F.col("__m") - lo))))
    return reduce(DataFrame.unionByName, parts).select(*kept, name)


def boosted_oof(df: DataFrame, features: list[str], fold: str, name: str = "boosted", **options) -> DataFrame:
    """Adds the out-of-fold prediction of boosted trees."""
    return predict_folds(df, fit_folds(df, features, fold, **options), fold, name)


def gain_shares(model: MonotoneModel) -> dict[str, float]:
    """Share of the gain by feature; features that no split uses have 0."""
    total = sum(model.gains.values()) or 1.0
    return {c: model.gains.get(c, 0.0) / total for c in model.features}


def permuted(df: DataFrame, column: str, order: list[Column], rows_each: int = 50_000) -> DataFrame:
    """The column with its values moved on by one row in a random order inside hash buckets of about ``rows_each`` rows."""
    buckets = max(1, -(-df.count() // rows_each))
    w = Window.partitionBy(F.pmod(F.xxhash64(*order, F.lit("bucket")), F.lit(buckets))).orderBy(F.xxhash64(*order), *order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(column, F.coalesce(F.lag(column).over(w), F.last(column).over(whole)))
