"""Registered queries for sources, sinks and caches: each writes a table, reads it back and returns what was read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.functions import names, sequence, vector
from seqlattice.operators import curation, metrics, models
from seqlattice.plans import reports
from seqlattice.plans.catalog import _SPLIT, _classification, _regression, _t, _xy, query
from seqlattice.plans.proxies import cte, spark_view
from seqlattice.sources import io
from seqlattice.streaming import incremental


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir; in a local session without it, of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.gettempdir()}/round-trip-{uuid.uuid4().hex}"


@query("s1_json_map", "SELECT n_name AS symbol, 0::BIGINT AS i, n_nationkey::DOUBLE AS v FROM nation UNION ALL SELECT n_name, 1, n_regionkey::DOUBLE FROM nation")
def _(spark, d):
    path = _folder(spark)
    entry = F.struct("n_name", F.array(F.col("n_nationkey").cast("float"), F.col("n_regionkey").cast("float")))
    _t(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(path)
    return io.json_map(spark, path, "vec", "array<float>").select("symbol", F.posexplode("vec").alias("i", "v")).select("symbol", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))


@query("s3_nomenclature", "SELECT p_name AS symbol, p_partkey::VARCHAR AS ensembl_id, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS gene_group, 'protein-coding gene' AS locus_group FROM part WHERE p_size % 3 <> 0")
def _(spark, d):
    path = _folder(spark)
    group, locus = F.when(F.col("p_size") % 4 != 0, F.col("p_type")), F.when(F.col("p_size") % 3 == 0, "pseudogene").otherwise(io.PROTEIN)
    of = (F.col("p_name").alias("symbol"), F.col("p_brand").alias("status"), F.col("p_partkey").alias("ensembl_gene_id"), group.alias("gene_group"), locus.alias("locus_group"))
    _t(spark, d, "part").select(*of).write.csv(path, sep="\t", header=True)
    return io.nomenclature(spark, path)


def _unsteady(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a server: some keys are unknown, some fail twice before they are answered."""
    for batch in batches:
        asked: dict[str, int] = {}

        def fetch(key: str, asked: dict[str, int] = asked) -> str | None:
            asked[key] = asked.get(key, 0) + 1
            if int(key) % 3 == 0 and asked[key] < 3:
                raise OSError(key)
            return None if int(key) % 10 == 0 else f"seq{key}"

        get = io.with_retries(fetch, pause=lambda seconds: None)
        yield pd.DataFrame({"s_suppkey": batch["s_suppkey"], "seq": pd.Series([get(str(k)) for k in batch["s_suppkey"]], dtype=object)})


@query("s6_fetch_with_retries", "SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 0 THEN 'seq' || s_suppkey END AS seq FROM supplier")
def _(spark, d):
    keys = _t(spark, d, "supplier").select("s_suppkey")
    return keys.mapInPandas(_unsteady, f"s_suppkey {dict(keys.dtypes)['s_suppkey']}, seq string")


@query("s8_cached_sequences", "SELECT s_suppkey, 'seq' || s_suppkey AS seq FROM supplier WHERE s_suppkey % 10 <> 0")
def _(spark, d):
    path, keys = _folder(spark), _t(spark, d, "supplier").select("s_suppkey")
    work = lambda todo: todo.mapInPandas(_unsteady, f"s_suppkey {dict(keys.dtypes)['s_suppkey']}, seq string")
    # a part is cached by an earlier run, which the second one does not ask for again
    incremental.refresh(_t(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey"), path, "s_suppkey", work)
    return incremental.cached(keys, path, "s_suppkey", work, "seq")


@query("s9_cached_windows", f"WITH {cte('coords')} SELECT DISTINCT chrom || ':' || lo || '..' || hi || ':1' AS region, (hi - lo + 1)::BIGINT AS n FROM coords")
def _(spark, d):
    path = _folder(spark)
    regions = spark_view(spark, d, "coords").select(sequence.region_name(F.col("chrom"), F.col("lo"), F.col("hi")).alias("region"), (F.col("hi") - F.col("lo") + 1).cast("int").alias("n")).distinct()
    found = incremental.cached(regions, path, "region", lambda todo: todo.select("region", F.repeat(F.lit("A"), F.col("n")).alias("seq")), "seq")
    return found.select("region", F.length("seq").cast("long").alias("n"))


@query("s11_split_manifest", f"WITH s AS (SELECT s_suppkey::VARCHAR AS id, {_SPLIT.format(s='s_nationkey', k='s_suppkey')} AS split FROM supplier) SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY id) - 1 AS pos FROM s")
def _(spark, d):
    path = _folder(spark)
    io.write_split_manifest(curation.stratified_split(_t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey"), path, "s_suppkey", stratify="s_nationkey", source="supplier")
    return io.split_manifest(spark, path).select("id", "split", F.col("pos").cast("long").alias("pos"))


@query("s13_saved_probe", "SELECT round(regr_slope(y, x), 6) AS w, round(regr_intercept(y, x), 6) AS b FROM (SELECT embedding[1]::DOUBLE AS x, embedding[49]::DOUBLE AS y FROM embeddings)")
def _(spark, d):
    path = _folder(spark)
    io.save_probe(spark, path, *models.gram(_xy(spark, d).select(F.slice("x", 1, 1).alias("x"), F.slice("y", 1, 1).alias("y"))).ridge(0.0), alpha=0.0)
    w, b = io.load_probe(spark, path)
    return spark.createDataFrame([(round(float(w[0, 0]), 6), round(float(b[0]), 6))], "w double, b double")


@query("s14_appended_run_log", f"WITH {cte('runs')} SELECT run_id::VARCHAR AS run_id, model, task, shuffled_labels, test_macro_f1, test_kappa FROM runs")
def _(spark, d):
    path, runs = _folder(spark), spark_view(spark, d, "runs")
    for part in ("task = 'family5'", "task <> 'family5'"):
        io.append_runs(runs.where(part), path)
    return io.run_log(spark, path).select("run_id", "model", "task", "shuffled_labels", "test_macro_f1", "test_kappa")


@query("s15_confusion_json", f"WITH {cte('preds')}, c AS (SELECT DISTINCT t FROM preds) SELECT a.t AS true, b.t AS pred, (SELECT count(*) FROM preds x WHERE x.t = a.t AND x.p = b.t) AS n FROM c a, c b")
def _(spark, d):
    path = _folder(spark)
    io.write_confusion(metrics.confusion(spark_view(spark, d, "preds"), "t", "p"), path)
    return io.confusion_json(spark, path).select("true", "pred", "n")


@query("s16_report", "SELECT n_name, printf('%.4f', n_nationkey / 8) AS share, CASE WHEN n_regionkey <> 0 THEN n_regionkey::VARCHAR END AS region FROM nation")
def _(spark, d):
    path = _folder(spark)
    table = _t(spark, d, "nation").select("n_name", (F.col("n_nationkey") / 8).alias("share"), F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")).alias("region"))
    io.report(table, path, "Nations")
    return spark.read.csv(f"{path}/csv", header=True)


@query("s17_manifest", "SELECT * FROM (VALUES ('inputs', 'runs'), ('outputs', 'main.csv'), ('outputs', 'main.md'), ('missing_cells', 'nt_v2')) t(kind, name)")
def _(spark, d):
    path = _folder(spark)
    io.manifest(spark, path, ["runs"], ["main.csv", "main.md"], ["nt_v2"])
    lists = spark.read.schema("inputs array<string>, outputs array<string>, missing_cells array<string>, skipped array<string>").json(path)
    parts = [lists.select(F.lit(c).alias("kind"), F.explode(c).alias("name")) for c in lists.columns]
    return reduce(DataFrame.unionByName, parts)


@query("s18_markdown_metrics", "SELECT 'family5' AS task, n_name AS label, n_nationkey / 8 AS value FROM nation")
def _(spark, d):
    path = _folder(spark)
    line = F.concat(F.lit("| **`"), "n_name", F.lit("`** (a note) | **"), (F.col("n_nationkey") / 8).cast("string"), F.lit("** |"))
    head = "# Summary\n\n| other | 1.5 |\n\n## Kappa by nation\n\n| label | kappa |\n| --- | --- |\n"
    _t(spark, d, "nation").agg(F.concat(F.lit(head), F.array_join(F.collect_list(line), "\n"), F.lit("\n\n## Notes\n\n| other | 2.5 |\n")).alias("value")).write.text(path)
    return io.markdown_metrics(spark, path, {"Kappa by nation": "family5"})


@query("q11_markdown_cell", "SELECT p_partkey, p_name AS cell FROM part")
def _(spark, d):
    return _t(spark, d, "part").select("p_partkey", sequence.markdown_cell(F.concat(F.lit(" **`"), "p_name", F.lit("`** ("), "p_brand", F.lit(") "))).alias("cell"))


#: Chunks of 50 vectors as tokens, the first and the last of each special; three ids share the chunks.
_CHUNKS = "x AS (SELECT vec_id // 50 AS chunk, vec_id % 50 AS pos, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), c AS (SELECT chunk, i, avg(v) AS special_mean, max(v) FILTER (pos NOT IN (0, 49)) AS max, max(v) FILTER (pos = 0) AS cls FROM x GROUP BY ALL)"


def _pooled_chunks(spark: SparkSession, d: str, pooling: str) -> DataFrame:
    pos, chunk = F.col("vec_id") % 50, F.floor(F.col("vec_id") / 50)
    tokens = _t(spark, d, "embeddings").select(chunk.alias("chunk"), pos.alias("pos"), F.col("embedding").alias("vec"), pos.isin(0, 49).alias("special"))
    chunks = vector.token_reductions(tokens, ["chunk"]).withColumn("id", F.col("chunk") % 3)
    out = vector.mean_of_chunks(chunks, "id", pooling).select("id", F.posexplode("x").alias("i", "v"))
    return out.select("id", F.col("i").cast("long").alias("i"), F.round("v", 8).alias("v"))


@query("v2_specialmean", f"WITH {_CHUNKS} SELECT chunk % 3 AS id, i - 1 AS i, round(avg(special_mean), 8) AS v FROM c GROUP BY ALL")
def _(spark, d):
    return _pooled_chunks(spark, d, "specialmean")


@query("v3_maxmean", f"WITH {_CHUNKS} SELECT chunk % 3 AS id, i - 1 AS i, round(avg(max), 8) AS v FROM c GROUP BY ALL")
def _(spark, d):
    return _pooled_chunks(spark, d, "maxmean")


@query("v4_clsmean", f"WITH {_CHUNKS} SELECT chunk % 3 AS id, i - 1 AS i, round(avg(cls), 8) AS v FROM c GROUP BY ALL")
def _(spark, d):
    return _pooled_chunks(spark, d, "clsmean")


#: The reduction at hand where the size is a multiple, and the poolings it allows, in their order.
_HAS = (("mean", 2), ("special_mean", 3), ("max", 5), ("cls", 7))
_ALLOWED = (("meanmean", 2), ("specialmean", 3), ("maxmean", 5), ("clsmean", 7), ("meanD", 2), ("meanG", 2))


@query("v7_available_poolings", "SELECT p_partkey, concat_ws(',', " + ", ".join(f"CASE WHEN p_size % {k} = 0 THEN '{n}' END" for n, k in _ALLOWED) + ") AS poolings FROM part")
def _(spark, d):
    has = F.array_compact(F.array(*[F.when(F.col("p_size") % k == 0, F.lit(n)) for n, k in _HAS]))
    return _t(spark, d, "part").select("p_partkey", F.array_join(vector.available_poolings(has), ",").alias("poolings"))


@query("v8_pooled_width", "SELECT pooling, hidden, hidden * CASE pooling WHEN 'meanD' THEN 3 WHEN 'meanG' THEN 4 ELSE 1 END AS width FROM (SELECT unnest(['base','meanmean','specialmean','meanD','meanG','maxmean','clsmean']) AS pooling), (SELECT unnest([256, 768]) AS hidden)")
def _(spark, d):
    return spark.createDataFrame([(p, h, vector.pooled_width(p, h)) for p in names.POOLING_ORDER for h in (256, 768)], "pooling string, hidden int, width int")


def _markdown(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = _folder(spark)
    io.report(df, path, name)
    return spark.read.text(f"{path}/markdown").select(F.lit(name).alias("name"), F.col("value").alias("line"))


@query("r11_markdown_tables")
def _(spark, d):
    # numbers that end in a five round by their decimals here, by their bits elsewhere: no SQL
    return _markdown(spark, reports.main_family5(_classification(spark, d)), "family5").unionByName(_markdown(spark, reports.main_regression(_regression(spark, d)), "regression"))


@query("r15_report_bundle")
def _(spark, d):
    path, tables = _folder(spark), reports.bundle(spark_view(spark, d, "runs"), names.feature_sources(spark))
    outputs = [x for name, df in tables.items() for x in io.report(df, f"{path}/{name}", name)]
    missing = [f"{r.artifact}:{r.feature_source}" for r in tables["missing_cells"].collect()]  # a registry's cells
    io.manifest(spark, f"{path}/manifest", [f"{d}/events.parquet"], outputs, missing)
    out = spark.read.schema("outputs array<string>, missing_cells array<string>").json(f"{path}/manifest")
    listed = F.concat(F.transform("outputs", lambda x: F.struct(F.lit("output").alias("kind"), F.substring_index(x, "/", -2).alias("name"))), F.transform("missing_cells", lambda x: F.struct(F.lit("missing").alias("kind"), x.alias("name"))))
    return out.select(F.explode(listed).alias("e")).select("e.*")
