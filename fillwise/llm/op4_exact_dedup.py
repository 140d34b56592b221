"""Exact duplicates with a log-structured merge index of text digests, in DataFrame operations only.

The rows come in slices. A slice is a memtable: one aggregation by digest, flushed as a run of (digest, smallest key,
rows) that is sorted by digest and has a filter (a bit map of its digests). Before a run joins the index, its digests
ask the filters of the runs that are there; only those that pass are looked up in the run itself. Runs of one level are
merged into one of the next by twos, which keeps the smallest key of each digest. What the lookups and the memtables
find are the digests that several rows have: all others are unique and never meet another row. Rows of a found digest
get byte verification: the smallest and the largest text under it must be the same, else its rows are grouped by text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm.common import KeyFilter, ascii_lower, scratch_path, with_groups, written

#: Slices of the input, and runs of a level that make one of the next.
SLICES, FANOUT = 4, 2


@dataclass
class Run:
    """A sorted table (digest, key, n) of a level, and the filter over its digests."""

    level: int
    rows: DataFrame
    filter: KeyFilter


class DigestIndex:
    """Live runs, newest last. Keys are ordered; the smallest of each digest stays."""

    def __init__(self, fanout: int = FANOUT):
        self.runs: list[Run] = []
        self.fanout = fanout

    def flush(self, memtable: DataFrame) -> DataFrame:
        """Adds (digest, key) rows as a run; the digests among them that now have several rows, each once."""
        rows = memtable.groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("n"))
        run = self._run(0, rows)
        found = run.rows.where("n > 1").select("digest")
        for old in self.runs:
            found = found.unionByName(self._known(old, run.rows.select("digest")))
        found = written(found.distinct(), "found")
        self.runs.append(run)
        while len(self.runs) >= self.fanout and len({r.level for r in self.runs[-self.fanout :]}) == 1:
            self._merge()
        return found

    def groups(self, digests: DataFrame) -> DataFrame:
        """(digest, key, n) over all runs, for the given digests."""
        asked = KeyFilter(digests, "digest")
        parts = None
        for run in self.runs:
            some = asked.mark(run.rows, "digest", "asked").where("asked").drop("asked").join(digests, "digest", "left_semi")
            parts = some if parts is None else parts.unionByName(some)
        return parts.groupBy("digest").agg(F.min("key").alias("key"), F.sum("n").alias("n"))

    @staticmethod
    def _known(run: Run, digests: DataFrame) -> DataFrame:
        """Those of the digests that a run has: past its filter, then in its rows."""
        passed = run.filter.mark(digests, "digest", "passed").where("passed").select("digest")
        return passed.join(run.rows.select("digest"), "digest", "left_semi")

    @staticmethod
    def _run(level: int, rows: DataFrame) -> Run:
        rows = written(rows.sortWithinPartitions("digest"), f"run{level}")
        return Run(level, rows, KeyFilter(rows, "digest"))

    def _merge(self) -> None:
        merged, rest = self.runs[-self.fanout :], self.runs[: -self.fanout]
        rows = merged[0].rows
        for run in merged[1:]:
            rows = rows.unionByName(run.rows)
        rows = rows.groupBy("digest").agg(F.min("key").alias("key"), F.sum("n").alias("n"))
        self.runs = [*rest, self._run(merged[0].level + 1, rows)]


def _text(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _key(doc_id: Column, row: Column, keep: str) -> Column:
    """The order in which rows of a group would stay: by id, null ids last, then by row."""
    order = -doc_id if keep == "largest" else doc_id
    return F.struct(doc_id.isNull().alias("none"), order.alias("order"), row.alias("row"), doc_id.alias("id"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", row_col: str | None = None, slices: int = SLICES
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each input row; with ``row_col`` also that column as ``row``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Rows repeated with one id
    count each in ``group_size`` and one of them is kept. Null ids: such rows are grouped and counted, and stay only
    where a group has no other id (then keep_id is null). Very long texts are hashed whole, and compared whole where
    they have a copy. An empty table gives an empty result. Other columns are ignored; their names don't matter.
    ``row_col`` numbers the rows, each once.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    spark = docs.sparkSession
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    read = docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), _digest(_text(text_col)).alias("digest"))
    read = read.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
    path = scratch_path(spark, "digests")
    read.write.partitionBy("slice").parquet(path)
    digests = spark.read.schema(read.schema).parquet(path)

    index, found = DigestIndex(), None
    for k in range(slices):
        memtable = digests.where(F.col("slice") == k).select("digest", _key(F.col("doc_id"), F.col("row"), keep).alias("key"))
        hits = index.flush(memtable)
        found = hits if found is None else found.unionByName(hits)
    found = written(found.distinct(), "found")
    groups = written(index.groups(found), "groups")
    marked = KeyFilter(found, "digest").mark(digests, "digest", "hit")
    hits = written(with_groups(marked.where("hit").drop("hit"), groups, "digest"), "hits")
    odd = _unequal(docs, hits, id_col, text_col)
    once = marked.where(~F.col("hit")).select(
        "doc_id", "row", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    several = hits.select(
        "doc_id", "row", "digest", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("key.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"), F.coalesce(F.col("key.row") == F.col("row"), F.lit(True)).alias("kept"),
    )
    if not odd.isEmpty():
        several = several.join(odd, "digest", "left_anti").unionByName(_apart(docs, odd, row, id_col, text_col, keep))
        once = once.join(odd, "digest", "left_anti")
    out = once.unionByName(several.select(once.columns))
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    return out.select(*columns, *(["row"] if row_col else []))


def _rows_with_text(docs: DataFrame, row: Column, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), _text(text_col).alias("text"))
    return rows.withColumn("digest", _digest(F.col("text")))


def _unequal(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Byte verification: digests under which texts differ. Only rows that may be in a group, null ids among them, are hashed again."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = KeyFilter(hits.where("n > 1"), "doc_id").mark(rows, "doc_id", "hit").where(F.col("hit") | F.col("doc_id").isNull())
    texts = _rows_with_text(marked, F.lit(0), "doc_id", "text").groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return written(texts.where("low <> high").select("digest"), "unequal")


def _apart(docs: DataFrame, odd: DataFrame, row: Column, id_col: str, text_col: str, keep: str) -> DataFrame:
    """The rows under digests whose texts differ, grouped by the text itself."""
    rows = written(_rows_with_text(docs, row, id_col, text_col).join(odd, "digest", "left_semi"), "apart")
    groups = rows.groupBy("digest", "text").agg(F.min(_key(F.col("doc_id"), F.col("row"), keep)).alias("key"), F.count("*").alias("group_size"))
    return rows.join(groups, ["digest", "text"]).select(
        "doc_id", "row", "digest", F.col("key.id").alias("keep_id"), "group_size", (F.col("key.row") == F.col("row")).alias("kept")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
