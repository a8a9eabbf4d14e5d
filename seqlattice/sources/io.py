"""Sources and sinks. Everything is read by Spark, so that paths may be in any store it reaches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlattice.functions import sequence

# Columns of the nomenclature file that are kept, and their names here.
NOMENCLATURE = {"symbol": "symbol", "ensembl_gene_id": "ensembl_id", "gene_group": "gene_group", "locus_group": "locus_group"}
PROTEIN = "protein-coding gene"

RUN_LOG = (
    "run_id string, timestamp string, model string, encoder string, feature_source string, dataset string, task string, shuffled_labels boolean, shuffle_seed int, "
    "C double, C_sweep array<struct<C:double,macro_f1:double>>, alpha double, alpha_sweep array<struct<alpha:double,mean_cosine:double>>, feature_dim int, "
    "test_macro_f1 double, test_kappa double, test_balanced_accuracy double, test_accuracy double, test_per_class_accuracy map<string,double>, "
    "test_mean_cosine double, test_median_cosine double, test_r2_macro double"
)


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def nomenclature(spark: SparkSession, path: str) -> DataFrame:
    """Protein-coding entries of a tab-separated nomenclature file, all columns text, missing groups empty."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"')
    kept = raw.select(*[F.col(c).cast("string").alias(n) for c, n in NOMENCLATURE.items()]).na.fill("", ["gene_group", "locus_group"])
    return kept.where(F.col("locus_group") == PROTEIN)


def json_map(spark: SparkSession, path: str, value: str, kind: str) -> DataFrame:
    """(symbol, value) from a JSON object of symbol -> value, e.g. kind array<float> for vectors, string for summaries."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{kind}>").alias("m"))
    return parsed.select(F.explode("m").alias("symbol", value))


def describe_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: n, least and greatest dimension, ten first keys, and what the keys look like."""
    keys = df.select(key).orderBy(key).limit(10).agg(F.array_sort(F.collect_list(F.col(key).cast("string"))).alias("sample"))
    stats = df.agg(
        F.count("*").alias("n"), F.min(F.size(vector)).alias("dim_min"), F.max(F.size(vector)).alias("dim_max"),
        F.count_if(F.col(key).cast("string").startswith("ENSG")).alias("_e"), F.count_if(F.col(key).cast("string").rlike("^[A-Z0-9]+$")).alias("_u"),
    )
    guess = F.when(F.col("_e") * 2 > F.col("n"), "ensembl").when(F.col("_u") * 2 > F.col("n"), "symbol").otherwise("unknown")
    return stats.withColumn("key_format", guess).drop("_e", "_u").crossJoin(keys)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): one record for each file, named by its file without extension."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("id"), sequence.fasta_sequence(F.col("value")).alias("seq"))


def canonical_transcript(json: Column) -> Column:
    """Transcript id in a lookup's JSON answer, without its version."""
    return F.split_part(F.get_json_object(json, "$.canonical_transcript"), F.lit("."), F.lit(1))


def with_retries(fetch: Callable[[str], str | None], attempts: int = 3, pause: Callable[[float], None] | None = None) -> Callable[[str], str | None]:
    """A fetch repeated after 1, 2, 4 .. seconds on errors. Answers of None (unknown key) are final. For ingest jobs, outside queries."""
    import time

    def run(key: str) -> str | None:
        for n in range(attempts):
            try:
                return fetch(key)
            except OSError:
                if n + 1 == attempts:
                    raise
                (pause or time.sleep)(2.0**n)
        return None

    return run


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, split, pos) from a JSON manifest; only its lists of the three splits are read, other keys are metadata."""
    schema = "train array<string>, val array<string>, test array<string>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    parts = [raw.select(F.posexplode_outer(s).alias("pos", "id"), F.lit(s).alias("split")).where("id is not null") for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "split", "pos")


def write_split_manifest(df: DataFrame, path: str, key: str, split: str = "split", seed: int = 42, stratify: str = "family", source: str = "") -> None:
    """One JSON object of id lists with metadata; for entity tables, whose ids fit one record."""
    lists = [F.array_sort(F.collect_list(F.when(F.col(split) == s, F.col(key).cast("string")))).alias(s) for s in ("train", "val", "test")]
    out = df.agg(*lists).select("*", F.lit(seed).alias("seed"), F.lit(stratify).alias("stratify"), F.lit(source).alias("source"))
    out.coalesce(1).write.mode("errorifexists").json(path)


def binary_manifest(df: DataFrame, key: str, label: str, positive: str, negative: str, task: str, seed: int = 42) -> DataFrame:
    """One row describing a balanced two-class subset with its splits (df has key, label, split)."""
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(key).cast("string"))))
    of = F.col(label)
    split = F.struct(*[ids(F.col("split") == s).alias(s) for s in ("train", "val", "test")])
    return df.agg(F.count_if(of == positive).alias("n_per_class"), ids(of == positive).alias("positive_ids"), ids(of == negative).alias("negative_ids"), split.alias("splits")).select(
        F.lit(task).alias("task"), F.lit(seed).alias("seed"), F.lit(positive).alias("positive"), F.lit(negative).alias("negative"), "n_per_class", "positive_ids", "negative_ids", "splits"
    )


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The run log, a folder of JSON records; keys a record does not have are null."""
    return spark.read.schema(RUN_LOG).json(path)


def append_runs(df: DataFrame, path: str) -> None:
    """Appends; nothing that is there is read or rewritten."""
    df.write.mode("append").json(path)


def save_probe(spark: SparkSession, path: str, w, b, **params) -> None:
    """A linear probe as rows (row, weights); row -1 is the intercept, and parameters stand in every row."""
    rows = [(-1, [float(x) for x in b])] + [(k, [float(x) for x in row]) for k, row in enumerate(w)]
    df = spark.createDataFrame(rows, "row int, weights array<double>")
    df.select("*", *[F.lit(v).alias(k) for k, v in params.items()]).write.mode("overwrite").parquet(path)


def load_probe(spark: SparkSession, path: str):
    import numpy as np

    rows = sorted(spark.read.parquet(path).select("row", "weights").collect())
    return np.array([r.weights for r in rows[1:]]), np.array(rows[0].weights)


def confusion_json(spark: SparkSession, path: str) -> DataFrame:
    """(true, pred, n) from {classes, matrix} objects, with the file each came from."""
    raw = spark.read.schema("classes array<string>, matrix array<array<long>>").json(path, multiLine=True).withColumn("file", F.input_file_name())
    rows = raw.select("file", "classes", F.posexplode("matrix").alias("i", "line")).select("file", "classes", "i", F.posexplode("line").alias("j", "n"))
    return rows.select("file", F.get("classes", F.col("i")).alias("true"), F.get("classes", F.col("j")).alias("pred"), "n")


def write_confusion(df: DataFrame, path: str) -> None:
    """(true, pred, n) as a {classes, matrix} object; there is a row for each pair of classes only."""
    lines = df.groupBy("true").agg(F.transform(F.array_sort(F.collect_list(F.struct("pred", "n"))), lambda x: x["n"]).alias("line"))
    whole = F.array_sort(F.collect_list(F.struct("true", "line")))
    lines.agg(F.transform(whole, lambda x: x["true"]).alias("classes"), F.transform(whole, lambda x: x["line"]).alias("matrix")).coalesce(1).write.mode("overwrite").json(path)


def markdown_metrics(spark: SparkSession, path: str, sections: dict[str, str]) -> DataFrame:
    """(task, label, value) from the tables of a Markdown summary: a section's title names the task, first cell the label, second the number."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    task = F.lit(None).cast("string")
    for title, name in sections.items():
        task = F.when(F.col("line").startswith("#") & F.contains(F.col("line"), F.lit(title)), F.lit(name)).otherwise(task)
    head = F.when(F.col("line").startswith("#"), F.coalesce(task, F.lit("")))
    # one small document: its lines are in one window
    named = lines.withColumn("task", F.last(head, ignorenulls=True).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.split("line", r"\|")
    number = F.regexp_replace(F.get(cells, F.lit(2)), r"[`*\s]", "")
    rows = named.where("task <> '' and line like '|%'").select("task", sequence.markdown_cell(F.get(cells, F.lit(1))).alias("label"), number.alias("number"))
    return rows.select("task", "label", F.col("number").try_cast("double").alias("value")).where("value is not null")


def report(df: DataFrame, path: str, title: str, overwrite: bool = False) -> list[str]:
    """A small ordered table as CSV and Markdown in two folders under path; numbers with four decimals, null blank.

    Refuses to replace what is there unless told to.
    """
    text = lambda c, t: F.format_string("%.4f", c) if t in ("double", "float") else c.cast("string")
    shown = df.select(*[F.when(F.col(f"`{c}`").isNull(), "").otherwise(text(F.col(f"`{c}`"), t)).alias(c) for c, t in df.dtypes])
    mode = "overwrite" if overwrite else "errorifexists"
    shown.coalesce(1).write.mode(mode).csv(f"{path}/csv", header=True)
    rows = [r for r in shown.collect()]  # a report table
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(str(x).replace("|", "/") for x in r) + " |" for r in rows]]
    df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/markdown")
    return [f"{path}/csv", f"{path}/markdown"]


def manifest(spark: SparkSession, path: str, inputs: Sequence[str], outputs: Sequence[str], missing: Sequence[str] = (), skipped: Sequence[str] = (), overwrite: bool = False) -> None:
    lists = [F.array(*[F.lit(x) for x in xs]).cast("array<string>").alias(n) for n, xs in (("inputs", inputs), ("outputs", outputs), ("missing_cells", missing), ("skipped", skipped))]
    spark.range(1).select(F.current_timestamp().alias("timestamp"), *lists).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def inspect(df: DataFrame, text: str | None = None, vector: str | None = None) -> DataFrame:
    """One row: rows, columns, and for a text its lengths, for a vector its norms and rows with NaN."""
    from seqlattice.functions import vector as v

    out = [F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns")]
    if text:
        n = F.length(text)
        out += [F.min(n).cast("long").alias("length_min"), F.median(n).cast("long").alias("length_median"), F.max(n).cast("long").alias("length_max")]
    if vector:
        out += [F.min(v.norm(F.col(vector))).alias("norm_min"), F.max(v.norm(F.col(vector))).alias("norm_max"), F.count_if(F.exists(vector, lambda x: F.isnan(x))).alias("n_nan")]
    return df.agg(*out)
