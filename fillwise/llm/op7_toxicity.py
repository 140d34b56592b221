"""Toxic passages as maximum-scoring segments of token log-odds.

Counting: in labelled training documents, each token stands for itself and for its prefixes of 3 to 8 letters. The
log-odds of a feature's tokens between toxic and other documents get a Dirichlet prior, and the documents that have it
say how far to trust them. Near copies count once. Features whose ratio is neither sure nor large are left out. A token
scores as its most decided feature, less a drift. Scanning: the Ruzzo-Tompa algorithm finds all maximal segments of a
text in linear time. Calibration is cross-fitted: each fifth of the training documents is scored by the counts of the
other four (total minus part). Lambda, the decay of the extreme-value law of clean text (Karlin-Altschul: expected number
of segments K n exp(-lambda S)), is the root of E exp(lambda s) = 1 over the token scores of clean texts, and K is fitted
to their best segments. Segments are added up in nats under that law and a logistic curve makes the sum a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm.common import texts_of, written

TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES, PARTS = (3, 4, 5, 6, 7, 8), 5
#: Most labelled documents that the fit reads (about): with them, all features and counts of the model are bounded.
MAX_TRAIN = 24_000
#: Counts that a task holds before it hands them on to be added up.
MAX_COUNTS = 50_000
MIN_Z, MIN_ODDS, DRIFT, PRIOR, MIN_PRIOR, MAX_E, MAX_LAMBDA, CACHE = 3.0, 1.0, 0.03, 0.5, 0.5, 0.05, 3.0, 60_000


def features(token: str) -> list[str]:
    return [token, *(token[:k] + "*" for k in PREFIXES if len(token) > k)]


def copy_key(text: str) -> int:
    """The smallest hash of five tokens in a row: near copies mostly share it."""
    words = TOKEN.findall(text.lower())
    return min(xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))) >> 1


def significance(d1: np.ndarray, d0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """z-scores of the log-odds of features in d1 of n1 toxic and d0 of n0 other documents, under a Dirichlet prior."""
    prior = PRIOR * (d1 + d0) / max(1.0, n1 + n0) + MIN_PRIOR
    a, b = d1 + prior, d0 + prior
    delta = np.log(a / np.maximum(n1 + 2 * MIN_PRIOR - a, MIN_PRIOR)) - np.log(b / np.maximum(n0 + 2 * MIN_PRIOR - b, MIN_PRIOR))
    return delta / np.sqrt(1 / a + 1 / b)


def log_odds(t1: np.ndarray, t0: np.ndarray, d1: np.ndarray, d0: np.ndarray, size1: float, size0: float) -> np.ndarray:
    """Log-odds of features with t1 of size1 toxic and t0 of size0 other tokens, in d1 and d0 documents.

    The prior is half a token in toxic texts and as much for their size in others. The ratio is given one standard
    deviation (by documents) nearer to 0, so that rare features claim less.
    """
    delta = np.log((t1 + PRIOR) / size1) - np.log((t0 + PRIOR * size0 / size1) / size0)
    sd = np.sqrt(1 / (d1 + MIN_PRIOR) + 1 / (d0 + MIN_PRIOR))
    return np.sign(delta) * np.maximum(np.abs(delta) - sd, 0.0)


def segments(scores: list[tuple[int, float, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), by Ruzzo and Tompa.

    ``scores`` has (token number, sum of all scores before it, its score) of the tokens that score above 0 only.
    """
    found: list[list] = []  # first, last, sum before, sum after
    for at, before, score in scores:
        new = [at, at, before, before + score]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


@dataclass
class ToxicModel:
    """What the fit learned; ``weights`` are the log-odds of the features that it trusts."""

    weights: dict[str, float]
    drift: float = 0.0
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    intercept: float = -2.0
    cache: int = CACHE

    def __post_init__(self) -> None:
        self._seen: dict[str, float] = {}
        self._heads = {f.removesuffix("*")[:3] for f in self.weights}

    def token_score(self, token: str) -> float:
        if token[:3] not in self._heads:  # no feature of the token has a weight
            return -self.drift
        got = self._seen.get(token)
        if got is None:
            got = max((w for f in features(token) if (w := self.weights.get(f))), key=abs, default=0.0) - self.drift
            if len(self._seen) > self.cache:
                self._seen.clear()
            self._seen[token] = got
        return got

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, maximal segments."""
        tokens = TOKEN.findall(text.lower()) if text else []
        score = np.fromiter(map(self.token_score, tokens), dtype=float, count=len(tokens))
        total = np.cumsum(score)
        up = np.flatnonzero(score > 0)
        return len(tokens), segments([(int(i), float(total[i] - score[i]), float(score[i])) for i in up])

    def nats(self, score: float, n: int) -> float:
        """-log of the expected number of such segments in n clean tokens."""
        return self.lam * score - math.log(self.k * max(n, 1))

    def statistic(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """log(1 + nats of the segments of which clean text would have less than one)."""
        return math.log1p(sum(max(0.0, self.nats(s, n)) for *_, s in found))

    def probability(self, n: int, found: list[tuple[int, int, float]]) -> float:
        z = self.intercept + self.slope * self.statistic(n, found)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def fold(id_col: str):
    """By crc32 of the id as text: mod 3 = 1 is held out (-1), the others are in one of PARTS parts."""
    code = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.when(code % 3 == 1, -1).otherwise(F.floor(code / 3) % PARTS).cast("int")


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    """(part, text, y, copy_key) of about ``max_train`` labelled documents at most; near copies with one label once."""
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) >= 0))
    y = y.groupBy(F.col(id_col).alias("of")).agg(F.max(label_col).cast("int").alias("y"))
    n = y.count()
    if n > max_train:
        y = y.where(F.pmod(F.xxhash64("of", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    rows = texts_of(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = rows.join(y, F.col("id") == F.col("of")).select("id", fold("id").alias("part"), "text", "y")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(copy_key=[copy_key(t) for t in pdf["text"]])

    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInPandas(keyed, f"id {kind}, part int, text string, y int, copy_key long")
    rows = rows.groupBy("copy_key", "y").agg(F.min_by(F.struct("part", "text"), "id").alias("x"))
    return written(rows.select("x.part", "x.text", "y"), "labelled")


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, counts): toxic documents, other documents, toxic tokens and other tokens of each part, one after the other."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["feature", "part", "d1", "d0", "t1", "t0"]
        for pdf in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for part, text, y in zip(pdf["part"], pdf["text"], pdf["y"], strict=True):
                if len(seen) > MAX_COUNTS:
                    yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=names)
                    seen = {}
                for f, n in Counter(f for t in TOKEN.findall(text.lower()) for f in features(t)).items():
                    got = seen.setdefault((f, part), [0, 0, 0, 0])
                    got[1 - y] += 1
                    got[3 - y] += n
            yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=names)

    counts = rows.mapInPandas(count, "feature string, part int, d1 long, d0 long, t1 long, t0 long")
    sums = [F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)) for k in range(PARTS) for c in ("d1", "d0", "t1", "t0")]
    return counts.groupBy("feature").agg(F.array(*sums).alias("counts")).where(
        " + ".join(f"counts[{4 * k}]" for k in range(PARTS)) + " >= 2 OR " + " + ".join(f"counts[{4 * k + 1}]" for k in range(PARTS)) + " >= 20"
    )


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_train: int = MAX_TRAIN,
) -> ToxicModel:
    """Learns from at most about ``max_train`` labelled documents, none of them held out.

    Feature counts are Spark aggregates. Only features that some count trusts and one short row for each training
    document reach the driver. Without toxic or without other labels every token scores 0.
    """
    rows = _labelled(docs, labels, id_col, text_col, label_col, max_train)
    sizes = np.zeros((PARTS, 4))
    tokens = F.regexp_count("text", F.lit(r"\p{L}+"))
    for r in rows.groupBy("part", "y").agg(F.count("*").alias("n"), F.sum(tokens).alias("t")).collect():
        sizes[r["part"], 1 - r["y"]] += r["n"]
        sizes[r["part"], 3 - r["y"]] += r["t"]
    # the model of part k counts all others; the last model counts all
    wholes = [*(sizes.sum(axis=0) - sizes[k] for k in range(PARTS)), sizes.sum(axis=0)]
    if not (wholes[-1] > 0).all():
        return ToxicModel({})

    def odds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = np.array(pdf["counts"].tolist(), dtype=float).reshape(len(pdf), PARTS, 4)
            weights = np.zeros((len(pdf), PARTS + 1))
            for k, (n1, n0, size1, size0) in enumerate(wholes):
                if min(n1, n0, size1, size0) > 0:
                    d1, d0, t1, t0 = (parts.sum(axis=1) - (parts[:, k] if k < PARTS else 0)).T
                    w = log_odds(t1, t0, d1, d0, size1, size0)
                    weights[:, k] = np.where((np.abs(significance(d1, d0, n1, n0)) >= MIN_Z) & (np.abs(w) >= MIN_ODDS), w, 0.0)
            some = (weights != 0).any(axis=1)
            yield pd.DataFrame({"feature": pdf["feature"][some].to_numpy(), "weights": pd.Series(list(weights[some]), dtype=object)})

    kept = _counts(rows).mapInPandas(odds, "feature string, weights array<double>").toPandas()
    models = [ToxicModel({f: w[k] for f, w in zip(kept["feature"], kept["weights"], strict=True) if w[k]}, cache=CACHE if k == PARTS else CACHE // PARTS) for k in range(PARTS + 1)]

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bins = Counter(round(100 * models[p].token_score(t)) for p, text in zip(pdf["part"], pdf["text"], strict=True) for t in TOKEN.findall(text.lower()))
            yield pd.DataFrame({"bin": list(bins), "n": list(bins.values())})

    bins = rows.where("y = 0").select("part", "text").mapInPandas(histogram, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    drift, lam = extreme_values(bins["bin"].to_numpy() / 100, bins["n"].to_numpy(float))
    for model in models:
        model.drift, model.lam = drift, lam
        model._seen.clear()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [models[p].scan(t) for p, t in zip(pdf["part"], pdf["text"], strict=True)]
            yield pd.DataFrame({"y": pdf["y"].to_numpy(), "n": [n for n, _ in got], "s": pd.Series([[x[2] for x in f] for _, f in got], dtype=object)})

    return calibrate(models[-1], rows.mapInPandas(scan, "y int, n long, s array<double>").toPandas())


def extreme_values(scores: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """(drift, lambda) from the scores of tokens in clean texts, before the drift, and how often each occurs.

    The drift makes the mean score negative; lambda is the positive root of E exp(lambda s) = 1, at most MAX_LAMBDA.
    """
    if not len(scores):
        return DRIFT, 1.0
    drift = max(DRIFT, float((scores * times).sum() / times.sum()) + DRIFT)
    scores = scores - drift
    low, high = 1e-3, MAX_LAMBDA
    for _ in range(60):
        mid = (low + high) / 2
        if (times * np.exp(np.minimum(mid * scores, 50.0))).sum() > times.sum():
            high = mid
        else:
            low = mid
    return drift, low


def calibrate(model: ToxicModel, rows: pd.DataFrame) -> ToxicModel:
    """K from the best segments of clean documents, then the logistic curve from all; rows: y, n tokens, s segment scores."""
    clean = rows[rows["y"] == 0]
    best = np.array([max(s, default=0.0) if len(s) else 0.0 for s in clean["s"]])
    spread = float((clean["n"].clip(lower=1).to_numpy() * np.exp(-model.lam * best)).sum())
    model.k = max(len(clean), 1) / max(spread, 1e-9)
    x = np.array([model.statistic(int(n), [(0, 0, v) for v in s]) for n, s in zip(rows["n"], rows["s"], strict=True)])
    y, w = rows["y"].to_numpy(float), np.array([0.0, 1.0])
    ridge = np.diag([1e-3, 1e-1])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        design = np.stack([np.ones_like(x), x])
        step = np.linalg.solve(design * (p * (1 - p)) @ design.T + ridge, design @ (p - y) + ridge @ w)
        w = w - np.clip(step, -2, 2)
    model.intercept, model.slope = float(w[0]), float(max(w[1], 0.0))
    return model


def score_documents(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, passages) of each row; a passage has its place in characters, score and expected number.

    Null and empty texts have no tokens: they get the curve's lowest score and no passages. Repeated rows score alike.
    Very long texts are scanned whole. An empty table gives an empty result. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    passage = "array<struct<start:int,end:int,score:double,expected:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = -math.log(MAX_E)
        for pdf in batches:
            scores, spans = [], []
            for text in pdf["text"]:
                n, found = model.scan(text)
                scores.append(model.probability(n, found))
                own = [(a, b, s, x) for a, b, s in found if (x := model.nats(s, n)) > floor]
                places = [m.span() for m in TOKEN.finditer(text.lower())] if own else []
                spans.append([{"start": places[a][0], "end": places[b][1], "score": s, "expected": math.exp(-x)} for a, b, s, x in own])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": scores, "passages": spans})

    rows = texts_of(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, f"doc_id {kind}, score double, passages {passage}")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_column(model: ToxicModel, text: Column) -> Column:
    """The score of a text column in place, for filters."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.probability(*model.scan(t)) for t in texts], dtype=float)

    return score(text)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_documents(docs, fit(docs, labels))
    held_out = F.coalesce(fold("doc_id") == -1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
