"""The corpus pipeline: five filtering and mixing stages over documents, each one operator of seqlattice.llm.

Rows are judged one by one. A null or empty text has no language and goes in the first stage; given to a later stage
by itself it loses no line, is a near-duplicate of other texts without words, overlaps with nothing, and is mixed with
size 0. Null ids are documents of their own, repeated rows further copies, an empty table stays empty, and columns
beyond those of documents are carried along, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seqlattice.llm import decontam, langid, line_dedup, mixing, simhash
from seqlattice.llm.common import prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear (no null or empty text is); ties go; dictionaries are fitted on a bounded sample of the labelled rows."""
    return langid.accepted(docs, langid.fit_languages(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat elsewhere; a null text stays null, of repeated rows each stays."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: all fingerprints within 10 bits propose links, a Jaccard similarity of 0.8 of five-word shingles confirms them."""
    return simhash.drop_near_duplicates(docs, shingle=2, radius=10, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of the benchmark table; null and empty texts overlap with none."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, a row for each copy; null and empty texts have size 0, a null source is a source."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", repeated_lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Compression, SimHash and spaced seeds are not expressible in SQL.
ORACLE_SQL = None


def _removed(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; between stages they are a table in the shared folder, so a lost executor repeats one stage at most.

    A stage's table goes when the next one is written. The last one stays: the result reads it.
    """
    prepare(spark)
    shared = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}")
        if k:
            _removed(spark, f"{shared}/{k - 1}")
        docs = spark.read.parquet(f"{shared}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
