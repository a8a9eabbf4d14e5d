"""Report tables, composed of ranking and metric operators over a run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlattice.functions import names
from seqlattice.operators import metrics, ranking

# Label, context, group, classification source, regression dataset, regression source.
CONTEXT = (
    ("CDS NT-v2 meanD", "CDS", "self-supervised encoder", "nt_v2_meanD", "dataset_nt_v2_meanD.parquet", "nt_v2_meanD"),
    ("CDS 4-mer", "CDS", "composition", "kmer", "kmer", "kmer"),
    ("TSS NT-v2 meanmean", "TSS window", "self-supervised encoder", "tss_nt_v2_meanmean", "dataset_tss_nt_v2_meanmean.parquet", "tss_nt_v2_meanmean"),
    ("TSS 4-mer", "TSS window", "composition", "enformer_tss_4mer", "dataset_enformer_tss_4mer.parquet", "enformer_tss_4mer"),
    ("Enformer trunk", "TSS window", "supervised comparator", "enformer_trunk_global", "dataset_enformer_trunk_center.parquet", "enformer_trunk_center"),
)
LEGACY_TASKS = ("tf_vs_gpcr", "tf_vs_kinase")
DELTAS = {"test_macro_f1": "delta_f1_vs_4mer", "test_kappa": "delta_kappa_vs_4mer", "test_accuracy": "delta_accuracy_vs_4mer"}
_ROW = ("encoder", "pooling", "feature_source", "test_macro_f1", "delta_f1_vs_4mer", "test_kappa", "delta_kappa_vs_4mer", "test_accuracy", "delta_accuracy_vs_4mer", "C", "timestamp")


def with_kappa(latest: DataFrame, confusion: DataFrame | None = None, summary: DataFrame | None = None) -> DataFrame:
    """test_kappa as recorded, else from a confusion table (source, true, pred, n), else from a summary (task, label, value)."""
    out = latest
    if confusion is not None:
        k = metrics.kappa_of_confusion(confusion, ["source"]).withColumnRenamed("kappa", "_k")
        out = out.join(k, "source", "left").withColumn("test_kappa", F.coalesce("test_kappa", F.when(F.col("task") == "family5", F.col("_k")))).drop("_k")
    if summary is not None:
        s = summary.select("task", F.col("label").alias("source"), F.col("value").alias("_k"))
        out = out.join(s, ["task", "source"], "left").withColumn("test_kappa", F.coalesce("test_kappa", "_k")).drop("_k")
    return out


def _named(latest: DataFrame) -> DataFrame:
    source = F.col("source")
    return latest.withColumn("feature_source", source).withColumn("encoder", F.coalesce(names.encoder_of(source), source)).withColumn("pooling", F.coalesce(names.pooling_of(source), F.lit("baseline")))


def family5(latest: DataFrame) -> DataFrame:
    """All family5 cells that are not shuffled, with deltas to 4-mers."""
    rows = _named(latest.where("task = 'family5' and not shuffled"))
    return ranking.minus_baseline(rows, rows.where("feature_source = 'kmer'"), DELTAS).select(*_ROW)


def pooling_sweep(latest: DataFrame) -> DataFrame:
    return ranking.in_paper_order(family5(latest).where(names.encoder_of(F.col("feature_source")).isNotNull()))


def _first_in_order() -> list[Column]:
    return [names.rank_of(F.col("pooling"), names.POOLING_ORDER), F.col("feature_source")]


def best_family5(latest: DataFrame) -> DataFrame:
    rows = family5(latest).where(names.encoder_of(F.col("feature_source")).isNotNull())
    return ranking.best(rows, ["encoder"], "test_macro_f1", _first_in_order())


def main_family5(latest: DataFrame) -> DataFrame:
    """4-mers, the best pooling of each encoder, the shuffled control."""
    kmer = family5(latest).where("feature_source = 'kmer'")
    control = _named(latest.where("task = 'family5' and shuffled and source = 'shuffled'")).withColumn("pooling", F.lit("anti_baseline"))
    control = ranking.minus_baseline(control, kmer, DELTAS).select(*_ROW)
    rank = lambda df, k: df.withColumn("_r", F.lit(k) + names.rank_of(F.col("encoder"), tuple(e[0] for e in names.ENCODERS)))
    whole = rank(kmer, -2000).unionByName(rank(best_family5(latest), 0)).unionByName(rank(control, 2000))
    return whole.orderBy("_r").drop("_r")


_REGRESSION = ("encoder", "pooling", "feature_source", "test_r2_macro", "delta_vs_4mer", "test_mean_cosine", "test_median_cosine", "alpha", "timestamp")


def regression_full(latest: DataFrame) -> DataFrame:
    """Every regression cell and one shuffled control, the best of them, with deltas to 4-mers."""
    feature = F.when(F.col("key") == "kmer", "kmer").otherwise(names.feature_of(F.col("key")))
    cells = latest.where("key not like 'shuffled_y:%'").withColumn("source", feature).where("source is not null")
    control = ranking.best(latest.where("key like 'shuffled_y:%'").withColumn("_all", F.lit(1)), ["_all"], "test_r2_macro", [F.col("key")]).drop("_all")
    control = control.select("*", F.lit("shuffled_y").alias("source"))
    rows = _named(cells.unionByName(control)).withColumn("pooling", F.when(F.col("source") == "shuffled_y", "-").otherwise(F.col("pooling")))
    return ranking.minus_baseline(rows, cells.where("key = 'kmer'"), {"test_r2_macro": "delta_vs_4mer"}).select(*_REGRESSION)


def main_regression(latest: DataFrame) -> DataFrame:
    """The control, 4-mers, and the best cell of each encoder."""
    return ranking.best(regression_full(latest), ["encoder"], "test_r2_macro", _first_in_order()).where(F.col("encoder").isin("shuffled_y", "kmer", *[e[0] for e in names.ENCODERS]))


def combined_summary(family: DataFrame, regression: DataFrame) -> DataFrame:
    """One row for each encoder or baseline in either table."""
    f = family.select(
        "encoder", F.col("feature_source").alias("family5_feature_source"), F.col("test_macro_f1").alias("family5_macro_f1"), F.col("test_kappa").alias("family5_kappa"), F.col("test_accuracy").alias("family5_accuracy")
    )
    r = regression.select("encoder", F.col("feature_source").alias("regression_feature_source"), F.col("test_r2_macro").alias("ridge_r2_macro"), F.col("delta_vs_4mer").alias("ridge_delta_vs_4mer"))
    return f.join(r, "encoder", "full_outer")


def context_ablation(classification: DataFrame, regression: DataFrame) -> DataFrame:
    """The fixed context cells with what is known of them; a dataset may be logged with its folder before it."""
    spark = classification.sparkSession
    spec = spark.createDataFrame(
        [(k, *row) for k, row in enumerate(CONTEXT)], "pos int, label string, context string, model_group string, family5_feature_source string, dataset string, regression_feature_source string"
    )
    c = classification.where("task = 'family5' and not shuffled").select(
        F.col("source").alias("family5_feature_source"), F.col("test_macro_f1").alias("family5_macro_f1"), F.col("test_kappa").alias("family5_kappa"), F.col("test_accuracy").alias("family5_accuracy")
    )
    r = regression.select(F.regexp_replace("key", "^data/", "").alias("dataset"), F.col("test_r2_macro").alias("ridge_r2_macro"), F.col("key").startswith("data/").alias("_far"))
    r = ranking.first_per_key(r, ["dataset"], [F.col("_far")]).drop("_far")
    out = spec.join(c, "family5_feature_source", "left").join(r, "dataset", "left").orderBy("pos")
    return out.select("label", "context", "model_group", "family5_feature_source", "regression_feature_source", "family5_macro_f1", "family5_kappa", "family5_accuracy", "ridge_r2_macro")


def legacy_binary(latest: DataFrame) -> DataFrame:
    rows = _named(latest.where(F.col("task").isin(*LEGACY_TASKS))).withColumn("shuffled_labels", F.col("shuffled"))
    order = [names.rank_of(F.col("task"), LEGACY_TASKS), names.rank_of(F.col("encoder"), tuple(e[0] for e in names.ENCODERS)), names.rank_of(F.col("pooling"), names.POOLING_ORDER), F.col("feature_source")]
    return rows.orderBy(*order).select("task", "encoder", "pooling", "feature_source", "test_macro_f1", "test_kappa", "test_accuracy", "C", "shuffled_labels")


def missing_cells(classification: DataFrame, regression: DataFrame, wanted: DataFrame) -> DataFrame:
    """(artifact, feature_source) of the registry without a run; baselines are not asked for."""
    cells = wanted.where(~F.col("feature_source").isin(*names.BASELINES)).select("feature_source")
    c = classification.where("task = 'family5' and not shuffled").select(F.lit("family5").alias("artifact"), F.col("source").alias("feature_source"))
    r = regression.select(F.lit("regression").alias("artifact"), names.feature_of(F.regexp_replace("key", "^data/", "")).alias("feature_source")).where("feature_source is not null")
    artifacts = cells.sparkSession.createDataFrame([("family5",), ("regression",)], "artifact string")
    return cells.crossJoin(F.broadcast(artifacts)).join(c.unionByName(r).distinct(), ["artifact", "feature_source"], "left_anti").select("artifact", "feature_source")


def gate_table(latest: DataFrame) -> DataFrame:
    """feature_source, delta_f1_vs_4mer, gate of the family5 cells."""
    return family5(latest).select("feature_source", "delta_f1_vs_4mer", metrics.gate(F.col("delta_f1_vs_4mer")).alias("gate"))


def full_matrix(latest: DataFrame) -> DataFrame:
    """A row for each source, macro-F1 of every task beside each other."""
    rows = latest.where("not shuffled")
    return rows.groupBy("source").pivot("task", list(names.TASKS)).agg(F.max("test_macro_f1"))


def pooling_matrix(latest: DataFrame) -> DataFrame:
    """A row for each encoder, best macro-F1 of every pooling beside each other."""
    rows = _named(latest.where("task = 'family5' and not shuffled")).where(names.encoder_of(F.col("source")).isNotNull())
    return rows.groupBy("encoder").pivot("pooling", list(names.POOLING_ORDER)).agg(F.max("test_macro_f1"))


def bundle(runs: DataFrame, wanted: DataFrame) -> dict[str, DataFrame]:
    """All report tables of a run log, by name. Both reductions of the log are shared."""
    c, r = ranking.latest_classification(runs).cache(), ranking.latest_regression(runs).cache()
    main_f, main_r = main_family5(c), main_regression(r)
    return {
        "main_family5": main_f, "pooling_sweep_family5": pooling_sweep(c), "regression_full": ranking.in_paper_order(regression_full(r)), "main_regression": main_r,
        "combined_model_summary": combined_summary(main_f, main_r), "context_ablation": context_ablation(c, r), "legacy_binary_appendix": legacy_binary(c),
        "missing_cells": missing_cells(c, r, wanted), "gates": gate_table(c), "full_matrix": full_matrix(c), "pooling_matrix": pooling_matrix(c),
    }
