"""The registered corpus queries: against their SQL where there is any, and the pipeline's stages on hard rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fillwise.llm import queries
from fillwise.llm.common import written
from fillwise.llm.op6_mixing import balanced_mix
from tests.llm.test_operators import SCHEMA, corpus
from tests.oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_quality_decides_where_labels_are_many(spark):
    """At a scale with enough labels the cutoffs reject documents, and SQL finds the same ones."""
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["kept"] for r in queries.queries()["op1_quality"](spark, sf).where("NOT base_failed").collect()}
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = dict(con.execute(f"SELECT doc_id, kept FROM ({queries.oracle_sql()['op1_quality']}) WHERE NOT base_failed").fetchall())
    assert got == want and 0 < sum(got.values()) < len(got)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("rows", [corpus(), []])
def test_stages_keep_columns_and_decide(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = written(stage(spark, docs, SF), "stage")
        if stage is not corpus_pipeline.pack_sequences:
            assert docs.columns == before
        if stage is corpus_pipeline.drop_exact_copies:
            texts = [(r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert (docs.count() > 0) == bool(rows)


def test_pipeline_runs_from_files(spark):
    assert corpus_pipeline.run(spark, SF).select("sequence_id").distinct().count() > 0


def test_pipeline_keeps_other_texts_of_a_repeated_id(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:-1] + ["changed"])
    rows = [(1, " ".join(words)), (2, near), (2, "a clean text of its own that is like no other one"), (1, " ".join(words)), (None, near), (3, None)]
    docs = spark.createDataFrame([(i, t, "web") for i, t in rows], "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if r != (2, near)], key=str)


def test_stages_carry_columns_of_any_name(spark):
    """Columns with the names that the stages and operators use inside keep their values."""
    names = ["__word", "__copy", "__flag", "__id", "__size", "row", "doc", "hit", "grp", "digest", "key", "word", "bits", "repeats", "Row"][:14]
    words = [f"w{i}" for i in range(60)]
    texts = {1: " ".join(words), 2: " ".join(words), 3: " ".join([*words[:-1], "changed"]), 4: "other words of a text", 5: None, 6: ""}
    rows = [(i, t, "web", *[100 * i + k for k in range(len(names))]) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    kept = {corpus_pipeline.drop_toxic: {1, 2, 3, 4, 5, 6}, corpus_pipeline.drop_exact_copies: {2, 3, 4, 6}, corpus_pipeline.drop_near_copies: {1, 4, 5, 6}}
    for stage, ids in kept.items():
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] in ids)
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= set(rows)


@pytest.mark.parametrize("doc_id", [None, 5])
def test_pipeline_mixes_rows_that_share_an_id(spark, doc_id):
    docs = spark.createDataFrame(
        [(doc_id, f"{s} {i} " + "word " * (8 + i % 3), s) for s, n in (("a", 300), ("b", 60), (None, 30)) for i in range(n)]
        + [(doc_id, "a like text", "a")] * 90, "doc_id long, text string, source string",
    )
    size = F.regexp_count("text", F.lit(r"\S+"))
    mix = balanced_mix(docs).groupBy("source").agg(F.max("target"), F.sum("taken")).collect()
    got = dict(corpus_pipeline.mix_sources(spark, docs, SF).groupBy("source").agg(F.sum(size)).collect())
    for source, target, _ in mix:
        assert abs(got[source] - target) < 25
    copies = corpus_pipeline.mix_sources(spark, docs, SF).groupBy("source", "text").count()
    most = {r["source"]: r["m"] for r in copies.groupBy("source").agg(F.max(F.when(F.col("text") != "a like text", F.col("count"))).alias("m")).collect()}
    for source, target, _ in mix:
        whole = docs.where(F.col("source").eqNullSafe(F.lit(source))).agg(F.sum(size)).first()[0]
        assert most[source] <= -(-target // whole)
