"""Latest per key, best per group, custom orders, baseline deltas. Every choice has a full tie-break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.functions import names


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; a group limit before the shuffle keeps hot keys small."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest(df: DataFrame, keys: Sequence[str], time: str = "timestamp", pos: str = "run_id") -> DataFrame:
    """The latest row of each key; of equal times the later entry."""
    return first_per_key(df, keys, [F.col(time).desc_nulls_last(), F.col(pos).desc()])


def latest_classification(runs: DataFrame) -> DataFrame:
    """Latest logistic run of each (source, task, shuffled); the source is the encoder, else the feature source."""
    rows = runs.where(F.col("model") == "logistic_probe").withColumn("source", F.coalesce("feature_source", "encoder")).withColumn("shuffled", F.coalesce("shuffled_labels", F.lit(False)))
    return latest(rows, ["source", "task", "shuffled"])


def regression_key(model: Column, dataset: Column) -> Column:
    data = F.coalesce(F.nullif(dataset, F.lit("")), F.lit("dataset.parquet"))
    return F.when(model == "kmer_baseline_4", F.lit("kmer")).when(model == "anti_baseline_shuffled_y", F.concat(F.lit("shuffled_y:"), data)).when(model == "linear_probe", data)


def latest_regression(runs: DataFrame) -> DataFrame:
    rows = runs.withColumn("key", regression_key(F.col("model"), F.col("dataset"))).where("key is not null")
    return latest(rows, ["key"])


def best(df: DataFrame, group: Sequence[str], value: str, ties: Sequence[Column]) -> DataFrame:
    """The row of the greatest value in each group, null last; only null is missing, zero is a value."""
    return first_per_key(df, group, [F.col(value).desc_nulls_last(), *ties])


def minus_baseline(df: DataFrame, baseline: DataFrame, values: dict[str, str]) -> DataFrame:
    """df with value - baseline value, for each value: name of its delta. baseline has one row, or none: deltas are null."""
    base = baseline.agg(*[F.max(v).alias(f"_b{k}") for k, v in enumerate(values)])
    out = df.crossJoin(F.broadcast(base))
    for k, (value, name) in enumerate(values.items()):
        out = out.withColumn(name, F.col(value) - F.col(f"_b{k}")).drop(f"_b{k}")
    return out


def in_paper_order(df: DataFrame, encoder: str = "encoder", pooling: str = "pooling", source: str = "feature_source") -> DataFrame:
    encoders = tuple(e[0] for e in names.ENCODERS)
    return df.orderBy(names.rank_of(F.col(encoder), encoders), names.rank_of(F.col(pooling), names.POOLING_ORDER), source)


def extremes(df: DataFrame, value: Column, k: int, ties: Sequence[str]) -> DataFrame:
    """The k greatest and the k smallest rows, with `cohort`; two top-k reductions, no sort of the whole."""
    v = df.withColumn("_v", value).where("_v is not null")
    top = v.orderBy(F.desc("_v"), *ties).limit(k).withColumn("cohort", F.lit("longest"))
    low = v.orderBy("_v", *ties).limit(k).withColumn("cohort", F.lit("shortest"))
    return top.unionByName(low).drop("_v")


def column_maxima(df: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    """(metric, label, value): the best label of each metric; the first label by name wins ties."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("e")).select(label, "e.*")
    return first_per_key(long.where("value is not null"), ["metric"], [F.desc("value"), F.col(label)])
