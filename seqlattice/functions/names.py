"""Encoder registry and the names of feature sources and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
ENCODERS = (
    # name, display name, longest chunk, overlap
    ("dnabert2", "DNABERT-2", 510, 64),
    ("nt_v2", "NT-v2 100M multi-species", 998, 64),
    ("gena_lm", "GENA-LM base", 510, 64),
    ("hyena_dna", "HyenaDNA large", 8192, 512),
)
VARIANTS = ("meanmean", "specialmean", "meanD", "meanG", "maxmean", "clsmean")
POOLING_ORDER = ("base", *VARIANTS)
TASKS = ("family5", "tf_vs_gpcr", "tf_vs_kinase")
BASELINES = ("kmer", "shuffled")
#: Datasets whose names do not follow their feature source.
OLD_DATASETS = {"dnabert2": "dataset.parquet", "nt_v2": "dataset_nt_v2.parquet"}


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENCODERS), "encoder string, display string, longest int, overlap int")


def feature_sources(spark: SparkSession, baselines: bool = True) -> DataFrame:
    """(feature_source, encoder, pooling) of every encoder and variant, then the baselines."""
    variants = spark.createDataFrame([(v,) for v in POOLING_ORDER], "pooling string")
    crossed = registry(spark).select("encoder").crossJoin(F.broadcast(variants))
    named = crossed.select(F.when(F.col("pooling") == "base", F.col("encoder")).otherwise(F.concat_ws("_", "encoder", "pooling")).alias("feature_source"), "encoder", "pooling")
    if not baselines:
        return named
    return named.unionByName(spark.createDataFrame([(b, b, "baseline") for b in BASELINES], "feature_source string, encoder string, pooling string"))


def known_encoder(name: str) -> tuple:
    for e in ENCODERS:
        if e[0] == name:
            return e
    raise ValueError(f"unknown encoder: {name!r}")


def encoder_of(feature: Column) -> Column:
    """Encoder of a feature source, the longest name that fits; null if none does."""
    out = F.lit(None).cast("string")
    for name in sorted((e[0] for e in ENCODERS), key=len):
        out = F.when((feature == name) | feature.startswith(name + "_"), F.lit(name)).otherwise(out)
    return out


def pooling_of(feature: Column) -> Column:
    encoder = encoder_of(feature)
    return F.when(feature == encoder, F.lit("base")).when(encoder.isNotNull(), F.substring(feature, F.length(encoder) + 2, F.length(feature)))


def dataset_of(feature: Column) -> Column:
    """File of a feature source; null for the baselines, which have none."""
    out = F.concat(F.lit("dataset_"), feature, F.lit(".parquet"))
    for name, file in OLD_DATASETS.items():
        out = F.when(feature == name, F.lit(file)).otherwise(out)
    return F.when(feature.isin("kmer", "shuffled", "length"), F.lit(None)).otherwise(out)


def feature_of(dataset: Column) -> Column:
    """Feature source of a dataset file; null if the name is not one."""
    out = F.nullif(F.regexp_extract(dataset, r"^dataset_(.*)\.parquet$", 1), F.lit(""))
    for name, file in OLD_DATASETS.items():
        out = F.when(dataset == file, F.lit(name)).otherwise(out)
    return out


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Place in a given order, 999 for what is not in it."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.coalesce(value, F.lit(""))), F.lit(0).cast("long")) - 1, F.lit(999)).cast("long")
