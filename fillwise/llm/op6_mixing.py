"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's target is its weight's share of all words, at most ``max_repeats`` times the source; what is cut off is
shared again by weight. A document is then taken floor(m) or floor(m) + 1 times, m being target / source size, and
the fractional part is its inclusion probability. The cube method decides: in the flight phase three undecided
documents at a time move along the direction in which neither the number of documents nor the number of words of the
source changes, until one of them reaches 0 or 1. Chunks of a source fly on their own; the two or three documents
that each chunk leaves undecided fly again together, level by level, until one small landing problem a source is left:
at most 13 documents, for which all choices are compared. Documents of more than a hundredth of their source's target are
decided before the others, which then share what is left of the target: no small document could make up for one of them
that the flight leaves for the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillwise.llm.common import WORD, written

#: Documents that fly together, those that wait for the landing of their source, and the part of a target from which a
#: document is decided before the others.
CHUNK, POOL, LARGE = 4000, 10, 100


def source_targets(sizes: DataFrame, max_repeats: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, get the weights in turn. A source is capped when its share, after the
    excess of all capped sources is shared again, would exceed ``max_repeats`` times its size. Capping goes by
    size / weight: with sources sorted by it, source i is capped exactly when the words left over for it and the
    later ones, shared by weight, still exceed its cap; so running sums replace the rounds of sharing.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("weight", turn)
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.lit(float(max_repeats)) * F.col("source_size")
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("cap", cap).withColumn("rate", left / weight_left).withColumn("place", F.row_number().over(by_ratio))
    per = per.withColumn("capped", F.col("rate") * F.col("weight") >= F.col("cap"))
    free_rate = F.min(F.when(~F.col("capped"), F.struct("place", "rate"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(free_rate["rate"] * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _unit(doc_id, seed: int) -> float:
    """A number in (0, 1) that depends on the document alone, so that reruns agree."""
    h = hashlib.blake2b(f"{seed}:{doc_id}".encode(), digest_size=8).digest()
    return (int.from_bytes(h, "little") + 0.5) / 2.0**64


def fly(ids: list, size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """The flight phase over one chunk: probabilities, of which at most two or three stay fractional."""
    p = p.astype(float).copy()
    active: list[int] = []
    eps = 1e-9
    for k in range(len(p)):
        if eps < p[k] < 1 - eps:
            active.append(k)
        if len(active) < 3:
            continue
        i, j, m = active
        # the direction that keeps the sums of 1 and of size: the cross product of (1, 1, 1) and the sizes
        v = (float(size[m] - size[j]), float(size[i] - size[m]), float(size[j] - size[i]))
        if v == (0.0, 0.0, 0.0):
            v = (1.0, -1.0, 0.0)
        up = min((1 - p[a]) / x if x > 0 else p[a] / -x for a, x in zip(active, v, strict=True) if x)
        down = min(p[a] / x if x > 0 else (1 - p[a]) / -x for a, x in zip(active, v, strict=True) if x)
        step = up if _unit(ids[k], seed) * (up + down) < down else -down
        for a, x in zip(active, v, strict=True):
            p[a] = min(1.0, max(0.0, p[a] + step * x))
            if p[a] < eps or p[a] > 1 - eps:
                p[a] = round(p[a])
        active = [a for a in active if eps < p[a] < 1 - eps]
    return p


def land(size: np.ndarray, p: np.ndarray, low: float, high: float) -> np.ndarray:
    """The landing phase for the documents that stay undecided: the choice nearest to their expected words and number.

    Words off by less than ``low`` or more than ``high`` are more than the others can make up for.
    """
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = choices - p[open_]
    words, number = off @ size[open_].astype(float), off.sum(axis=1)
    beyond = np.maximum(0.0, np.maximum(low - words, words - high))
    cost = (np.abs(words) + 1000 * beyond) / max(1.0, float(size.mean())) + 0.02 * np.abs(number)
    out = p.copy()
    out[open_] = choices[np.argmin(cost)]
    return out


def _level(rows: DataFrame, chunk: int, last: bool, seed: int, name: str) -> DataFrame:
    """Flies every chunk of every source once; with ``last`` the landing follows."""
    counts = rows.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("of_n"))
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("of"))).select(
        *rows.columns, F.pmod(F.xxhash64("key", F.lit(seed)), F.ceil(F.col("of_n") / chunk).cast("long")).alias("chunk")
    )
    columns = [c for c in rows.columns if c != "chunk"]

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("key", "ascending"), ("size", "ascending")]).select(columns)
        keys = part["key"].to_pylist()
        size, p = part["size"].to_numpy(), part["p"].to_numpy()
        fliers = max(0, len(p) - POOL) if last else len(p)
        p = np.concatenate([fly(keys[:fliers], size[:fliers], p[:fliers], seed), p[fliers:]])
        if last:
            p = land(size, p, part["low"][0].as_py(), part["high"][0].as_py())
        return part.set_column(columns.index("p"), "p", pa.array(p, pa.float64()))

    schema = T.StructType([f for f in rows.schema if f.name in columns])
    return written(rows.groupBy("source", "chunk").applyInArrow(run, schema), name)


def _decided(rows: DataFrame, chunk: int, seed: int, name: str) -> DataFrame:
    """The rows with p 0 or 1: flights of chunks, level by level, then the landing."""
    done: list[DataFrame] = []
    n = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    level = 0
    while True:
        last = n <= chunk
        rows = _level(rows, chunk, last, seed + level, name)
        if last:
            done.append(rows)
            break
        settled = (F.col("p") < 1e-9) | (F.col("p") > 1 - 1e-9)
        done.append(rows.where(settled))
        rows = rows.where(~settled)
        n = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def balanced_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None,
    max_repeats: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), chunk: int = CHUNK, seed: int = 7,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, repeats) for each row; with ``row_col`` also that column as ``row``.

    A null text has size 0. Null sources are one source, the last. Rows repeated with one id are separate documents
    (alike ones are interchangeable). Null ids are documents like others: what decides is a hash of id and text. Very
    long texts are counted whole. Sources without words have target 0. An empty table gives an empty result. Other
    columns are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    own = ["row"] if row_col else []
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), *([F.col(row_col).alias("row")] if row_col else []),
    )
    sizes = written(sizes, "sizes")
    targets = written(source_targets(sizes, max_repeats, weights), "targets")
    s, t = sizes.alias("s"), targets.alias("t")
    rows = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "t.source_size", "t.target")
    m = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rows = rows.withColumn("base", F.floor(m + F.lit(1e-12)).cast("int")).withColumn("p", F.greatest(m - F.col("base"), F.lit(0.0)))
    large = F.col("size") * LARGE > F.col("target")
    heavy = rows.where(large).groupBy(F.col("source").alias("of")).agg(F.sum("size").alias("theirs"))
    first = rows.where(large).join(written(heavy, "large"), F.col("source").eqNullSafe(F.col("of")))
    # what the others can take less or more than their share
    spare = F.col("source_size") - F.col("theirs")
    first = first.withColumns({"low": (F.col("base") + F.col("p") - float(max_repeats)) * spare, "high": (F.col("base") + F.col("p")) * spare})
    out = _decided(first.select(*rows.columns, "low", "high"), chunk, seed, "mix-large")
    took = out.groupBy(F.col("source").alias("of")).agg(F.sum((F.col("base") + F.rint("p")) * F.col("size")).alias("took"), F.sum("size").alias("theirs"))
    rest = rows.where(~large).join(written(took, "took"), F.col("source").eqNullSafe(F.col("of")), "left")
    m = F.greatest(F.lit(0.0), F.least(F.lit(float(max_repeats)), F.try_divide(F.col("target") - F.col("took"), F.col("source_size") - F.col("theirs"))))
    m = F.when(F.col("took").isNull(), F.col("base") + F.col("p")).otherwise(F.coalesce(m, F.lit(0.0)))
    rest = rest.withColumn("m", m).withColumn("base", F.floor(F.col("m") + F.lit(1e-12)).cast("int"))
    rest = rest.withColumn("p", F.greatest(F.col("m") - F.col("base"), F.lit(0.0))).select(*rows.columns, F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    out = out.unionByName(_decided(rest, chunk, seed, "mix-level"))
    repeats = (F.col("base") + F.rint("p")).cast("int")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (repeats * F.col("size")).alias("taken"), repeats.alias("repeats"), *own
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = balanced_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "repeats")
