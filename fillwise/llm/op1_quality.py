"""Quality rules with risk-controlled thresholds.

Four integer statistics of a text (percentages, higher is worse) each reject a document above a cutoff. A stratum
(language) has one cutoff for all of them, so that a document is rejected by the largest of its percentages. Labelled
documents are the holdout: nothing else is fitted on them, since the candidate cutoffs are fixed beforehand. For each
stratum and cutoff the number of good holdout documents that it would reject gives an exact binomial test of "rejects
more than ``risk`` of the good ones". Going from the mildest cutoff to stricter ones, testing stops at the first that
fails (its p-values only grow), so a stratum's cutoffs need no further correction; strata get Holm's correction of
``delta``. With probability 1 - delta no stratum then loses more than ``risk`` of its good documents to all rules
together. A stratum with too few labels (fewer than about 60 to 90) gets no cutoff and loses nothing to the rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillwise.llm.common import SEPARATORS, texts_of, written

SYMBOLS = "#*$%&|<>"
RULES = ("symbol_pct", "shout_pct", "dup_line_pct", "repeat_pct")
#: Candidate cutoffs, the same for all rules, chosen before any label is seen.
CUTOFFS = (1, 2, 5, 10, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90)
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: Strata up to which the table of cutoffs is broadcast.
MAX_STRATA = 10_000


def text_statistics(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_shout) of one text.

    n_lines counts lines with a word; n_shout counts characters of A-Z and ``!``.
    """
    if not text:
        return (0,) * 7
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at exactly the six separators
    chars = len(text) - sum(text.count(c) for c in SEPARATORS)
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shout = sum(map(raw.count, [bytes([c]) for c in range(65, 91)])) + raw.count(b"!")
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words), shout


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text has twice or more, each word once."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = np.append((times[window] > 1), [False, False])
    return int((twice | np.roll(twice, 1) | np.roll(twice, 2)).sum())


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, ..., n_shout): text_statistics() of each row."""
    kind, group = (docs.schema[c].dataType.simpleString() for c in (id_col, stratum_col))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shout")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([text_statistics(t) for t in pdf["text"]], columns=names, index=pdf.index, dtype="int64")
            yield pd.concat([pdf[["doc_id", "stratum"]], got], axis=1)

    rows = texts_of(docs).select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, stratum {group}, " + ", ".join(f"{n} long" for n in names))


def with_rules(stats: DataFrame) -> DataFrame:
    """Adds the base verdict and the four rule statistics, whole percentages."""
    pct = lambda a, b: F.coalesce(F.floor(F.try_divide(100 * F.col(a), F.col(b))), F.lit(0)).cast("long")
    return stats.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")),
            "symbol_pct": pct("n_symbols", "n_words"),
            "shout_pct": pct("n_shout", "word_chars"),
            "dup_line_pct": pct("n_dup_lines", "n_lines"),
            "repeat_pct": pct("n_repeat_words", "n_words"),
        }
    ).withColumn("worst_pct", F.greatest(*RULES))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the regularised incomplete beta I(1 - p; n - k, k + 1), by continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_fraction(b, a, 1.0 - x)
    return _beta_fraction(a, b, x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return front * f


def select_cutoffs(holdout: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, cutoff, n, k, p_value) of the strictest certified cutoff of each stratum that has one.

    ``holdout`` has the stratum and ``worst_pct`` of good labelled documents that pass the base rules. The p-values are
    computed on one row for each stratum and cutoff.
    """
    counts = holdout.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("worst_pct") > c).alias(f"k{c}") for c in CUTOFFS])
    tests = counts.select(
        "stratum", "n", F.inline(F.array(*[F.struct(F.lit(c).cast("long").alias("cutoff"), F.col(f"k{c}").alias("k")) for c in CUTOFFS])),
    )

    @F.pandas_udf("double")
    def p_value(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b), risk) for a, b in zip(k, n, strict=True)])

    tests = tests.withColumn("p_value", p_value("k", "n"))
    # Holm over strata, each with the p-value of its mildest cutoff
    first = tests.groupBy("stratum").agg(F.min("p_value").alias("best"))
    order = Window.orderBy("best", F.col("stratum").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.lit(delta) / (F.count("*").over(everything) - F.row_number().over(order) + 1)
    families = first.withColumn("level", level)
    families = families.withColumn("open", F.min((F.col("best") <= F.col("level")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    t, f = tests.alias("t"), families.alias("f")
    certified = t.join(f, F.col("t.stratum").eqNullSafe(F.col("f.stratum"))).where("f.open AND t.p_value <= f.level")
    return certified.groupBy("t.stratum").agg(F.min_by(F.struct("cutoff", "n", "k", "p_value"), "cutoff").alias("x")).select("stratum", "x.*")


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    label_col: str = "quality", risk: float = 0.05, delta: float = 0.05,
) -> DataFrame:
    """The statistics, base_failed, kept and failed_rules of each row.

    Null or empty texts have no words and fail the base rules. Null strata are one stratum. Labels that are null, or
    of documents that are not there, count for nothing; a document labelled twice counts once, as good only if all its
    labels say so. Repeated rows are judged each for itself. Very long texts are counted whole. An empty table gives an empty result. Other columns are
    ignored.
    """
    stats = written(with_rules(with_statistics(docs, id_col, text_col, stratum_col)), "quality")
    good = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y"))
        .where("__id IS NOT NULL AND __y IS NOT NULL").groupBy("__id").agg(F.min("__y").alias("__y")).where("__y = 1")
    )
    holdout = stats.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("__id"), "left_semi")
    cutoffs = written(select_cutoffs(holdout, risk, delta), "cutoffs")
    s, c = stats.alias("s"), cutoffs.select(F.col("stratum").alias("of"), "cutoff")
    out = s.join(F.broadcast(c) if c.count() <= MAX_STRATA else c, F.col("stratum").eqNullSafe(F.col("of")), "left").drop("of")
    failed = F.filter(F.array(*[F.when(F.col(r) > F.col("cutoff"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    out = out.withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_verdicts(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_VALUES = ", ".join(f"({c})" for c in CUTOFFS)
OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times
  FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
rep AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM win WHERE times > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (
  SELECT d.doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z!]', '', 'g')) AS n_shout
  FROM d LEFT JOIN lines ON d.doc_id = lines.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id),
r AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
    coalesce(100 * n_symbols // nullif(n_words, 0), 0) AS symbol_pct, coalesce(100 * n_shout // nullif(word_chars, 0), 0) AS shout_pct,
    coalesce(100 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_line_pct, coalesce(100 * n_repeat_words // nullif(n_words, 0), 0) AS repeat_pct
  FROM s),
k AS (
  SELECT lang, cutoff, count(*) AS n, count(*) FILTER (greatest(symbol_pct, shout_pct, dup_line_pct, repeat_pct) > cutoff) AS k
  FROM r, (VALUES {_VALUES}) c(cutoff)
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) GROUP BY lang, cutoff),
p AS (
  SELECT lang, cutoff, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))
    FROM (SELECT unnest(range(0, k + 1)) AS i)) AS p_value FROM k),
best AS (SELECT lang, min(p_value) AS best FROM p GROUP BY lang),
lev AS (SELECT lang, best, 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY best, lang NULLS LAST) + 1) AS lv FROM best),
holm AS (
  SELECT lang, lv, min(CASE WHEN best <= lv THEN 1 ELSE 0 END) OVER (ORDER BY best, lang NULLS LAST ROWS UNBOUNDED PRECEDING) AS ok FROM lev),
lim AS (
  SELECT p.lang, min(cutoff) AS cutoff FROM p JOIN holm ON p.lang IS NOT DISTINCT FROM holm.lang
  WHERE ok = 1 AND p_value <= lv GROUP BY p.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(greatest(symbol_pct, shout_pct, dup_line_pct, repeat_pct) > cutoff, false) AS kept
FROM r LEFT JOIN lim ON r.lang IS NOT DISTINCT FROM lim.lang
"""
