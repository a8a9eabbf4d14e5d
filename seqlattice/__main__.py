"""Command line: python -m seqlattice COMMAND --help. Tables are Parquet folders unless a command says otherwise."""

from __future__ import annotations

import argparse
import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.functions import names, sequence, vector
from seqlattice.operators import curation, metrics, models
from seqlattice.plans import reports
from seqlattice.sources import io


def _logged(df: DataFrame, path: str, **fields) -> None:
    stamp = datetime.datetime.now(datetime.UTC).isoformat()
    io.append_runs(df.select(F.lit(uuid.uuid4().hex).alias("run_id"), F.lit(stamp).alias("timestamp"), *[F.lit(v).alias(k) for k, v in fields.items()], "*"), path)


def curate(spark, a) -> DataFrame:
    """Nomenclature TSV and embeddings (symbol, y) to an entity table (symbol, ensembl_id, family, summary, y)."""
    genes = curation.keep_known(io.nomenclature(spark, a.nomenclature), spark.read.parquet(a.embeddings), "symbol")
    placed = curation.assign_capped(genes, "symbol", "gene_group", "symbol", curation.rules_named(a.families), a.cap)
    out = placed.select("symbol", "ensembl_id", "family").join(spark.read.parquet(a.embeddings).select("symbol", "y"), "symbol")
    if a.summaries:
        return curation.with_lookup(out, io.json_map(spark, a.summaries, "summary", "string"), "symbol", "summary", "")
    return out.withColumn("summary", F.lit(""))


def fasta(spark, a) -> DataFrame:
    """A folder of FASTA files to (id, seq)."""
    return io.fasta(spark, a.source).where(F.length("seq") > 0)


def kmers(spark, a) -> DataFrame:
    """(id, seq) to (id, x), k-mer frequencies."""
    return sequence.kmer_frequencies(spark.read.parquet(a.source), "id", "seq", a.k)


def lengths(spark, a) -> DataFrame:
    """(id, seq) to (id, x), the logarithm of the length."""
    return spark.read.parquet(a.source).select("id", F.array(sequence.log_length(F.col("seq"))).alias("x"))


def windows(spark, a) -> DataFrame:
    """(id, seq) to chunk windows of an encoder."""
    _, _, longest, overlap = names.known_encoder(a.encoder)
    return sequence.chunks(spark.read.parquet(a.source), "id", F.length("seq"), longest, overlap)


def tss(spark, a) -> DataFrame:
    """(id, chrom, start, end, strand) to windows around the transcription start."""
    low, high = sequence.tss_window(F.col("start"), F.col("end"), F.col("strand"), a.length)
    df = spark.read.parquet(a.source)
    return df.select("id", "chrom", low.alias("win_start"), high.alias("win_end"), sequence.region_name(F.col("chrom"), low.cast("long"), high.cast("long")).alias("region"))


def pool(spark, a) -> DataFrame:
    """(id, chunk_no, vec) of one reduction to (id, x) of a pooling."""
    vector.pooled_width(a.pooling, 1)
    p = vector.pooled(spark.read.parquet(a.source), "id")
    return p.select("id", {"meanD": vector.mean_d(p), "meanG": vector.mean_g(p)}.get(a.pooling, p["mean_vec"]).alias("x"))


def split(spark, a) -> DataFrame:
    """A table with a column split added."""
    return curation.stratified_split(spark.read.parquet(a.source), a.key, a.stratum, a.seed)


def binary(spark, a) -> DataFrame:
    """A balanced two-class subset with label 1 for the positive class and a stratified split."""
    some = curation.balanced_sample(spark.read.parquet(a.source), a.key, a.stratum, [a.positive, a.negative], a.seed)
    return curation.stratified_split(some, a.key, a.stratum, a.seed).withColumn("label", (F.col(a.stratum) == a.positive).cast("int"))


def ridge(spark, a) -> DataFrame:
    """(x, y, split) to test scores of a ridge probe; with --shuffled, targets are permuted within train and val."""
    df = spark.read.parquet(a.source)
    if a.shuffled:
        df = curation.permuted_labels(df.where("split <> 'test'"), a.key, "y", "split", a.seed).unionByName(df.where("split = 'test'"))
    out = models.ridge_protocol(df).select(
        F.col("mean_cosine").alias("test_mean_cosine"), F.col("median_cosine").alias("test_median_cosine"), F.col("r2_macro").alias("test_r2_macro"), "alpha"
    )
    if a.log:
        model = "anti_baseline_shuffled_y" if a.shuffled else "kmer_baseline_4" if a.feature == "kmer" else "linear_probe"
        dataset = spark.range(1).select(names.dataset_of(F.lit(a.feature))).first()[0]
        _logged(out, a.log, model=model, **({"dataset": dataset} if dataset else {}))
    return out


def logistic(spark, a) -> DataFrame:
    """(x, label, split) to test scores of a logistic probe; with --shuffled, labels are permuted within train and val."""
    df = spark.read.parquet(a.source)
    if a.shuffled:
        df = curation.permuted_labels(df.where("split <> 'test'"), a.key, "label", "split", a.seed).unionByName(df.where("split = 'test'"))
    out = models.logistic_protocol(df).select(
        F.col("macro_f1").alias("test_macro_f1"), F.col("kappa").alias("test_kappa"), F.col("balanced_accuracy").alias("test_balanced_accuracy"), F.col("accuracy").alias("test_accuracy"), "C"
    )
    if a.log:
        _logged(out, a.log, model="logistic_probe", feature_source="shuffled" if a.shuffled else a.feature, task=a.task, shuffled_labels=a.shuffled)
    return out


def mlp(spark, a) -> DataFrame:
    """(id, x, y, split) to scores of small neural probes."""
    return models.mlp_protocol(spark.read.parquet(a.source), [{"hidden": h, "rate": r} for h in (64, 256, 1024) for r in (1e-4, 1e-3, 1e-2)])


def bootstrap(spark, a) -> DataFrame:
    """Predictions (key, true, pred), or (key, y, p) with --regression, to intervals."""
    df = spark.read.parquet(a.source)
    return models.bootstrap_regression(df, a.key, "y", "p", a.replicates, a.seed) if a.regression else models.bootstrap_classification(df, a.key, "true", "pred", a.replicates, a.seed)


def confusion(spark, a) -> DataFrame:
    """Predictions (true, pred) to a long confusion table with row shares."""
    return metrics.row_normalised(metrics.confusion(spark.read.parquet(a.source), "true", "pred"))


def inspect(spark, a) -> DataFrame:
    """Counts, lengths of a text column, norms of a vector column."""
    return io.inspect(spark.read.parquet(a.source), a.text, a.vector)


def report(spark, a) -> None:
    """All report tables of a run log (JSON), as CSV and Markdown, and a manifest."""
    made = []
    for name, table in reports.bundle(io.run_log(spark, a.source), names.feature_sources(spark)).items():
        made += io.report(table, f"{a.out}/{name}", name, a.overwrite)
    io.manifest(spark, f"{a.out}/manifest", [a.source], made, overwrite=a.overwrite)


COMMANDS = {f.__name__: f for f in (curate, fasta, kmers, lengths, windows, tss, pool, split, binary, ridge, logistic, mlp, bootstrap, confusion, inspect, report)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqlattice", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        p = subs.add_parser(name, help=f.__doc__)
        if name == "curate":
            p.add_argument("nomenclature")
            p.add_argument("embeddings")
            p.add_argument("--summaries")
            p.add_argument("--families", nargs="*", help="short names; all without any")
            p.add_argument("--cap", type=int)
        else:
            p.add_argument("source")
        p.add_argument("--out", required=name not in ("inspect", "ridge", "logistic", "mlp", "bootstrap"))
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--key", default="id")
        if name in ("split", "binary"):
            p.add_argument("--stratum", default="family")
        if name == "binary":
            p.add_argument("--positive", required=True)
            p.add_argument("--negative", required=True)
        if name in ("ridge", "logistic"):
            p.add_argument("--feature", default="kmer")
            p.add_argument("--task", default="family5", choices=names.TASKS)
            p.add_argument("--shuffled", action="store_true")
            p.add_argument("--log")
        if name == "kmers":
            p.add_argument("--k", type=int, default=4)
        if name == "windows":
            p.add_argument("--encoder", default="dnabert2")
        if name == "tss":
            p.add_argument("--length", type=int, default=196_608)
        if name == "pool":
            p.add_argument("--pooling", default="meanD")
        if name == "bootstrap":
            p.add_argument("--replicates", type=int, default=1000)
            p.add_argument("--regression", action="store_true")
        if name == "inspect":
            p.add_argument("--text")
            p.add_argument("--vector")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("seqlattice").getOrCreate()
    out = COMMANDS[a.command](spark, a)
    if out is not None and a.out:
        out.write.mode("overwrite" if a.overwrite else "errorifexists").parquet(a.out)
    elif out is not None:
        out.show(100, truncate=False)


if __name__ == "__main__":
    main()
