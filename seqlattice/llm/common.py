"""Shared pieces of the training-data operators: lineage cuts, Arrow batches, forests and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker; whole texts are long, so a row count alone bounds nothing.
BATCH_BYTES = "4m"


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and make sure that checkpoint() has a folder all executors share.

    The folder is the one named in spark.checkpoint.dir. Only in a local session where that is unset, as in tests, a
    temporary folder of this machine is used; on a cluster that is an error. Files of checkpoints that are no longer
    referenced go with spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation of what stands before."""
    prepare(df.sparkSession)
    return df.checkpoint()


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding it to Python strings."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest connected index of each of n items, from batches of linked index pairs; vectorised hooking and pointer jumping."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def forest_pairs(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]], forests: int = 1, spare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of linked index pairs, made of pairs that were given; of each batch, earlier pairs are preferred.

    Pairs that the first forest does not take are open to the next: any set of nodes that `forests` pairs connect to
    the rest keeps that many, so some pairs may be taken away later. There are fewer than forests * n pairs. `spare`,
    n flags, is set for both ends of every pair that no forest takes.
    """
    roots = [np.arange(n) for _ in range(forests)]
    left, right = [], []
    for i, j in pairs:
        for f in range(forests):
            root, open_ = roots[f], np.ones(len(i), bool)
            at = np.arange(len(i))
            while True:
                a, b = root[i[at]], root[j[at]]
                at, a, b = at[a != b], a[a != b], b[a != b]
                if not len(at):
                    break
                high, first = np.unique(np.maximum(a, b), return_index=True)
                left.append(i[at[first]])
                right.append(j[at[first]])
                open_[at[first]] = False
                root[high] = np.minimum(a, b)[first]
                while not np.array_equal(up := root[root], root):
                    root = up
            roots[f] = root
            i, j = i[open_], j[open_]
        if spare is not None:
            spare[i] = spare[j] = True
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list, component being the smallest reachable node.

    Alternating large-star and small-star steps over the edges alone. Each step groups with map-side partial
    minima and joins them back, so a node with very many edges is never gathered in one task; each round is
    cut by a checkpoint. Nodes without an edge are not returned. Null ends are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        e = cut(small.select("e.*").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
