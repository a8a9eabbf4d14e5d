"""The registered queries against SQL or their contracts, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import FOLDER
from seqlattice.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize(("name", "table"), [("op2_quality_ordinal", "documents"), ("op6_language_id", "documents"), ("op7_pii_pseudonyms", "documents"), ("op8_quote_linking", "conversations"), ("op9_simhash_dedup", "documents")])
def test_one_row_for_each_input_row(name, table, spark):
    assert QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_language_columns(spark):
    got = QUERIES["op6_language_id"](spark, FOLDER)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (None, "", "en", None, 0), (9002, "", None, "src0", 0)], docs.schema)
    for rows in (docs, docs.unionByName(odd).unionByName(docs.limit(3)), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, FOLDER)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER).columns == docs.columns


def test_pipeline_decisions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "source_mixing"]
    found = {r.doc_id for r in QUERIES["op10_decontamination"](spark, FOLDER).select("doc_id").collect()}
    left = {r.doc_id for r in stages["decontamination"](spark, docs, FOLDER).select("doc_id").collect()}
    assert found and left == {r.doc_id for r in docs.select("doc_id").collect()} - found
    copies = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100_000))
    once, twice = ({r.doc_id for r in stages["simhash_near_dedup"](spark, d, FOLDER).select("doc_id").collect()} for d in (docs, copies))
    assert once == twice
    assert corpus_pipeline.run(spark, FOLDER).count() > 50
