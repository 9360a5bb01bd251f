"""The pipeline's stages, each against what its operator says of its own input."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from netprobe.functions.tables import materialize
from netprobe.llm import mixing, neardup, quality


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "minhash_neardup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), "test-stage")
        own = {r.doc_id for r in docs.select("doc_id").collect()}
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept and kept <= own
        if name == "quality_rules":
            assert kept == {r.doc_id for r in quality.query(docs).filter("kept").collect()}
        if name == "minhash_neardup":
            assert kept == {r.doc_id for r in neardup.query(docs).filter("kept").collect()}
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test-empty")
        assert docs.count() == 0


def test_odd_rows(spark, sf_dir):
    """Nulls in any column, repeated rows, empty and long texts, and columns named like the stages' own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    good = docs.filter("text IS NOT NULL").first().text
    none = [None] * 4
    odd = spark.createDataFrame([(None, good + " of its own", *none[:3]), (-1, None, *none[:3]), (-2, "", *none[:3]), (-3, " ".join([good] * 40), "en", None, 7)], docs.schema)
    rows = docs.unionByName(docs.limit(5)).unionByName(odd)
    rows = rows.withColumns({"size": F.lit(-7), "n": F.lit(1), "kept": F.lit("k"), "lang_pred": F.lit("x"), "comp": F.lit("c")})
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, rows, sf_dir), "test-odd")
        assert not out.isEmpty()
        if name != "packing":
            assert out.columns == rows.columns and out.filter("size <> -7 OR kept <> 'k' OR comp <> 'c'").isEmpty()
            assert out.filter("doc_id IN (-1, -2)").isEmpty()
        rows = out


def test_the_mix_draws_its_slots_once(spark, sf_dir):
    """The draws are a table of their own, not five copies in one plan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan and plan.count("Window [") <= 10
