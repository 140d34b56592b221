"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that the stage before it kept and returns those that it keeps, with their columns; the
last returns the pieces with their places in sequences. Decisions are taken for rows, not for ids: a stage that joins
decisions back first writes its rows with a number. Ids, texts and sources may be null and rows may repeat; a null text
counts as empty, very long texts are taken whole. Extra columns pass through whatever their names are: the row travels
as one struct. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm.common import KeyFilter, table, written
from fillwise.llm.op2_jaccard import near_duplicates
from fillwise.llm.op4_exact_dedup import exact_groups
from fillwise.llm.op6_mixing import balanced_mix
from fillwise.llm.op7_toxicity import fit, toxicity_column
from fillwise.llm.op9_packing import packed_sequences, public_tokenizer

TOXIC = 0.7


def with_rows(docs: DataFrame) -> DataFrame:
    """(row, doc): the documents as a table of numbered rows; ``doc`` has all columns."""
    return written(
        docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "rows"
    )


def decided(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents of the rows but those that ``verdicts`` (row) names. Only rows that may be named move."""
    marked = KeyFilter(verdicts, "row").mark(rows, "row", "hit")
    rest = marked.where("hit").join(verdicts, "row", "left_anti")
    return marked.where(~F.col("hit")).select("doc.*").unionByName(rest.select("doc.*"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; null and empty texts stay."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_column(model, F.col("text")) < TOXIC)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts: that with the largest id, of rows alike in it the first; null ids stay only without another id."""
    rows = with_rows(docs)
    groups = exact_groups(rows.select("row", "doc.doc_id", "doc.text"), row_col="row")
    return decided(rows, written(groups.where(~F.col("kept")).select("row"), "copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, then digest.

    A document is an id with a text: where an id repeats with another text, that is a document of its own. Rows alike in
    both stay or go together. Rows with a null id and texts without words stay.
    """
    rows = with_rows(docs)
    found = near_duplicates(rows.select("row", "doc.doc_id", "doc.text").where("doc_id IS NOT NULL"), id_col="row")
    found = found.where("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("grp"))
    several = written(found.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp"), "several")
    found = written(found.join(several, "grp", "left_semi"), "near-copies")
    some = KeyFilter(found, "row").mark(rows, "row", "hit").where("hit")
    some = some.select("row", F.struct("doc.doc_id", F.sha2(F.coalesce("doc.text", F.lit("")), 256).alias("sum")).alias("key"))
    some = written(some.join(found, "row"), "keys")
    kept = some.groupBy("grp").agg(F.min("key").alias("kept"))
    return decided(rows, written(some.join(kept, "grp").where("key <> kept").select("row"), "gone"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, rows alike in id, text and source each by a decision of their own."""
    rows = with_rows(docs)
    mix = balanced_mix(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), row_col="row").where("repeats > 0")
    taken = written(mix.select("row", "repeats"), "taken")
    both = rows.join(taken, "row")
    return both.select("doc", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packed_sequences(docs, **public_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near duplicates", drop_near_copies),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn a classifier, sample and pack: SQL cannot express them. tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
