"""Exact cosine neighbours of a stated query set, in blocks, against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12
#: Queries compared in one scan of the base.
BLOCK = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), TINY)


def _top(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        best_s, best_i = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.concatenate((best_s, q @ _matrix(batch.column(1)).T), axis=1)
            i = np.concatenate((best_i, np.broadcast_to(batch.column(0).to_numpy(), (len(ids), batch.num_rows))), axis=1)
            # a place more than k for the query itself
            order = np.lexsort((i, -s), axis=1)[:, : k + 1]
            best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        n = best_s.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_i.ravel()), pa.array(best_s.ravel())], names=["query", "neighbour", "cosine"])

    return run


def neighbours(base: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = True, block: int = BLOCK) -> DataFrame:
    """(query, neighbour, cosine, rank): the k most similar rows of base for each query, ties by id.

    Each scan keeps k + 1 rows of a query in each task, so the shuffle is queries x tasks x k rows. Null vectors are left out.
    """
    spark = base.sparkSession
    rows = base.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col)
    found, some = None, []

    def scan(taken):
        ids = np.array([t[0] for t in taken], np.int64)
        q = _matrix(pa.array([t[1] for t in taken], pa.list_(pa.float64())))
        return rows.mapInArrow(_top(spark.sparkContext.broadcast((ids, q)), k), "query long, neighbour long, cosine double")

    for r in queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v")).toLocalIterator():
        some.append((r.i, list(r.v)))
        if len(some) == block:
            found = scan(some) if found is None else found.unionByName(scan(some))
            some = []
    if some or found is None:
        one = scan(some) if some else spark.createDataFrame([], "query long, neighbour long, cosine double")
        found = one if found is None else found.unionByName(one)
    if skip_self:
        found = found.where("query <> neighbour")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")).cast("long"))
    return ranked.where(F.col("rank") <= k)


def vote_agreement(neighbours_: DataFrame, labels: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(query, agree): neighbours that have the query's own label."""
    a = labels.select(F.col(id_col).alias("query"), F.col(label_col).alias("ql"))
    b = labels.select(F.col(id_col).alias("neighbour"), F.col(label_col).alias("nl"))
    return neighbours_.join(a, "query").join(b, "neighbour").groupBy("query").agg(F.count_if(F.col("ql") == F.col("nl")).alias("agree"))
