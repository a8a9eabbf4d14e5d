"""Stand-ins, on the test tables, for the entities the operators work on; one SQL text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = "kmer,shuffled,dnabert2,dnabert2_meanD,dnabert2_meanG,nt_v2,nt_v2_meanD,nt_v2_meanmean,gena_lm_meanD,gena_lm_maxmean,hyena_dna,hyena_dna_meanG,enformer_tss_4mer,enformer_trunk_global"
_SOURCE = f"split_part('{SOURCES}', ',', cast(user_id % 14 as int) + 1)"

TEXTS = {
    # run log: events
    "runs": f"""SELECT event_id AS run_id, ts AS timestamp,
  CASE WHEN event_id % 4 < 2 THEN 'logistic_probe' WHEN event_id % 4 = 2 AND user_id % 10 = 0 THEN 'kmer_baseline_4'
       WHEN event_id % 4 = 2 AND user_id % 10 = 1 THEN 'anti_baseline_shuffled_y' ELSE 'linear_probe' END AS model,
  {_SOURCE} AS feature_source, CAST(NULL AS STRING) AS encoder,
  CASE event_type WHEN 'purchase' THEN 'tf_vs_gpcr' WHEN 'error' THEN 'tf_vs_kinase' ELSE 'family5' END AS task,
  user_id % 14 = 1 AS shuffled_labels,
  CASE WHEN event_id % 50 = 0 THEN 'data/' ELSE '' END || CASE WHEN user_id % 14 < 2 THEN 'dataset_nt_v2.parquet' WHEN user_id % 14 = 2 THEN 'dataset.parquet'
       ELSE 'dataset_' || {_SOURCE} || '.parquet' END AS dataset,
  value / 500e0 AS test_macro_f1, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 600e0 END AS test_kappa, value / 450e0 AS test_accuracy, 10e0 AS C,
  value / 1000e0 - 5e-2 AS test_r2_macro, value / 400e0 AS test_mean_cosine, value / 410e0 AS test_median_cosine, 1e0 AS alpha FROM {{events}}""",
    # sequences: document letters as bases, anything else breaks windows
    "seqs": "SELECT doc_id, source, lang, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM {documents}",
    # labelled predictions
    "preds": "SELECT vec_id, CAST(label AS STRING) AS t, CAST(CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS STRING) AS p FROM {embeddings}",
    # entities with a group text, for rules
    "genes": "SELECT p_partkey AS id, p_name || ' ' || p_type AS text, p_brand AS grp FROM {part}",
    # multi-output targets: halves of a vector
    "pairs": "SELECT vec_id, embedding AS e FROM {embeddings}",
    # coordinates
    "coords": "SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 22 + 1 AS STRING) AS chrom, l_orderkey % 5000 + 1 AS lo, l_orderkey % 5000 + 1 + CAST(l_quantity AS BIGINT) * 10 AS hi, CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END AS strand FROM {lineitem}",
}
TABLES = {"runs": "events", "seqs": "documents", "preds": "embeddings", "genes": "part", "pairs": "embeddings", "coords": "lineitem"}


def spark_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table = TABLES[name]
    return spark.sql(TEXTS[name], **{table: spark.read.parquet(f"{folder}/{table}.parquet")})


def cte(*names: str) -> str:
    return ",\n".join(f"{n} AS ({TEXTS[n].format(**{TABLES[n]: TABLES[n]})})" for n in names)
