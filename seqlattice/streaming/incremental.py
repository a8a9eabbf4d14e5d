"""Incremental work: only what is not cached yet. The engine has no event-time operators; this is its one incremental idea."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(inputs: DataFrame, cache: DataFrame, key: str, required: Sequence[str] = ()) -> DataFrame:
    """Inputs without a cache entry; an entry that lacks a required column's value does not count."""
    whole = cache
    for c in required:
        whole = whole.where(F.col(c).isNotNull()) if c in cache.columns else whole.limit(0)
    return inputs.join(whole.select(key), key, "left_anti")


def skip_existing(wanted: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted cells without a run; keys are compared whole."""
    return wanted.join(runs.select(*keys).distinct(), list(keys), "left_anti")


def refresh(inputs: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Work on what is pending in the cache at path, append the results, return how many inputs were pending."""
    spark = inputs.sparkSession
    try:
        cache = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001 - no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = inputs.select(key).limit(0)
    todo = pending(inputs, cache, key).cache()
    n = todo.count()
    if n:
        work(todo).write.mode("append").parquet(path)
    todo.unpersist()
    return n


def cached(inputs: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], value: str) -> DataFrame:
    """The cache at path after a refresh, without the keys whose value is null or empty; those are not asked for again."""
    refresh(inputs, path, key, work)
    return inputs.sparkSession.read.parquet(path).where(F.length(value) > 0)
