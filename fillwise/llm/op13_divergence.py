"""How far the sources of a language are from each other and from the language, over run-length columns of term counts.

Counting: tasks count terms by (language, source) in bounded tables and hand them on to be added up. A language keeps the
terms that enough of its documents have. Its vocabulary is dealt into blocks of terms with about equal totals. In a block
the terms are put in an order that brings equal counts together; each source's counts become runs. For two sources the
run boundaries are intersected, so that a term's share f is computed once for each common run and multiplied by its
length. Blocks add up.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillwise.llm.common import texts_of, written

#: A term in UTF-8: ASCII letters and whatever is not ASCII. GAP is what ends it.
TERM, GAP = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")
#: Bytes of a text that are cut into terms at a time, and counts that a task holds.
PIECE, MAX_HELD = 1 << 20, 200_000
#: Terms of a block; a block has less than twice as many.
BLOCK_TERMS = 2048
UNIT, SMOOTH = 1_000_000_000, 2


def terms_of(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text with A-Z lower-cased, in lists of about ``piece`` bytes; no term is cut."""
    lo = 0
    while lo < len(text):
        hi = lo + piece
        if hi < len(text):
            gap = GAP.search(text, hi)
            hi = gap.start() if gap else len(text)
        yield TERM.findall(text[lo:hi].lower())
        lo = hi


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            terms = [None, *found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                    pa.array([0, *found.values()], pa.int64()), pa.array([0, *map(docs[lang, source].__getitem__, found)], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            seen: set = set()
            for terms in terms_of(text):
                counts[lang, source].update(terms)
                seen.update(terms)
            counts[lang, source].update(())
            docs[lang, source].update(seen)
            if sum(map(len, counts.values())) > MAX_HELD:
                yield from flush()
    yield from flush()


def group_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) of every group, and one row without a term for each group."""
    text, lang, source = (F.coalesce(F.col(c), F.lit("")) for c in (text_col, lang_col, source_col))
    read = texts_of(docs.select(lang.alias("lang"), source.alias("source"), text.cast("binary").alias("text")))
    found = read.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, size: int, v: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / (size + SMOOTH * v)), exactly."""
    if len(counts) and int(counts.max()) + SMOOTH >= 2**63 // UNIT:
        counts = counts.astype(object)
    return (1 + UNIT * (counts + SMOOTH) // (size + SMOOTH * v)).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def run_lengths(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first positions, values) of the runs of each row of ``matrix`` (sources by terms) after the terms are reordered.

    The terms are sorted by the counts of all rows, the row with the most occurrences first: terms with equal counts
    everywhere lie side by side.
    """
    order = np.lexsort(matrix[np.argsort(matrix.sum(axis=1), kind="stable")]) if matrix.size else np.arange(matrix.shape[1])
    out = []
    for row in matrix[:, order]:
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        out.append((starts, row[starts]))
    return out


def over_runs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> int:
    """Sum of the distance of two run-length columns (first positions, shares) of n terms."""
    cuts = np.union1d(a[0], b[0])
    p, q = (values[np.searchsorted(starts, cuts, "right") - 1] for starts, values in (a, b))
    return int((distance(p, q) * np.diff(np.append(cuts, n))).sum())


def _block_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value) for all sources a < b of one block of terms."""
    heads = rows[rows["term"].isna()].sort_values("source")
    sources, cells = heads["source"].tolist(), rows[rows["term"].notna()]
    term, names = pd.factorize(cells["term"])
    matrix = np.zeros((len(sources), len(names)), np.int64)
    matrix[heads["source"].searchsorted(cells["source"]), term] = cells["n"]
    runs = [(at, shares(c, size, v)) for (at, c), size, v in zip(run_lengths(matrix), heads["size"].tolist(), heads["v"].tolist(), strict=True)]
    i, k = np.triu_indices(len(sources), 1)
    value = [over_runs(runs[x], runs[y], len(names)) for x, y in zip(i, k, strict=True)]
    named = np.array(sources, dtype=object)
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "a": named[i], "b": named[k], "value": np.array(value, np.int64)})


def _share(count: str, size: str) -> Column:
    return F.expr(f"1 + CAST(({UNIT} * CAST({count} + {SMOOTH} AS DECIMAL(20,0))) DIV CAST({size} + {SMOOTH} * v AS DECIMAL(20,0)) AS BIGINT)")


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): 'pair' has every other source of the language, 'term' the ``top`` terms.

    A null text, language or source is ''. A row is a document: repeated rows and ids count each. Texts of any length are
    read whole. Sources without terms have all counts 0; a language without kept terms has pairs of value 0 and no terms.
    Ties rank by the bytes of the item. An empty table gives an empty result. Other columns are ignored; their names
    don't matter. The result has all pairs of a language's sources; a task holds a block's counts of these sources.
    """
    cells = written(group_counts(docs, text_col, lang_col, source_col), "cells")
    kept = cells.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = written(kept.where(F.col("docs") >= min_docs).select("lang", "term", "total"), "kept")
    known = written(cells.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "known")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
    groups = cells.groupBy("lang", "source").agg(F.lit(0).alias("none")).drop("none")
    groups = groups.join(known.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.na.fill(0, ["size", "v", "lang_size"]), "groups")

    value = F.expr("(p - q) * (p - q) DIV (p + q)")
    term = known.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "size"), "q": _share("total", "lang_size")})
    term = term.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    pair = _pairs(known, kept, groups, block_terms)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [
        pair.withColumn("rank", place).withColumn("part", F.lit("pair")),
        term.withColumn("rank", place).where(F.col("rank") <= top).withColumn("part", F.lit("term")),
    ]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def _pairs(known: DataFrame, kept: DataFrame, groups: DataFrame, block_terms: int) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of a language's sources."""
    before = Window.partitionBy("lang").orderBy("total").rowsBetween(Window.unboundedPreceding, -1)
    classes = kept.groupBy("lang", "total").agg(F.count("*").alias("terms"))
    classes = classes.withColumn("block", F.floor(F.coalesce(F.sum("terms").over(before), F.lit(0)) / block_terms))
    # terms of one total that fill blocks of their own are dealt by a hash
    classes = classes.select("lang", "total", "block", F.when(F.col("terms") > block_terms, F.ceil(F.col("terms") / block_terms)).otherwise(0).alias("parts"))
    salt = F.when(F.col("parts") > 0, 1 + F.pmod(F.xxhash64("term"), F.col("parts"))).otherwise(0)
    cells = written(known.join(classes, ["lang", "total"]).select("lang", "block", salt.alias("part"), "source", "term", "n"), "dealt")
    # every language has a block without terms, so that every pair comes out
    blocks = cells.select("lang", "block", "part").union(groups.select("lang", F.lit(-1).cast("long"), F.lit(0).cast("long"))).distinct()
    heads = groups.join(blocks, "lang").select("lang", "block", "part", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "size", "v")
    none = F.lit(0).cast("long")
    rows = heads.unionByName(cells.withColumns({"size": none, "v": none}))
    half = rows.groupBy("lang", "block", "part").applyInPandas(_block_pairs, "lang string, a string, b string, value long")
    half = half.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return half.select("lang", F.explode(both).alias("at"), "value").select("lang", "at.source", "at.item", "value")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT lang, source, id, unnest(terms) AS term FROM d) GROUP BY lang, source, term),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, CAST(sum(total) AS HUGEINT) AS size FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, k.term, k.total, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
z AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS size FROM s GROUP BY lang, source),
p AS (SELECT s.lang, s.source, term, n, 1 + 1000000000 * (n + 2) // (z.size + 2 * v) AS p, 1 + 1000000000 * (total + 2) // (l.size + 2 * v) AS q
  FROM s JOIN z ON z.lang = s.lang AND z.source = s.source JOIN l ON l.lang = s.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""
