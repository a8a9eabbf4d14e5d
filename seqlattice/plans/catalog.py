"""Registered queries for the operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.functions import names, sequence, vector
from seqlattice.operators import curation, metrics, models, ranking, retrieval
from seqlattice.plans import reports
from seqlattice.plans.proxies import cte, spark_view
from seqlattice.sources import io
from seqlattice.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Rules over part names, overlapping on purpose.
RULES = (("bolts", "Bolts", ("bolt",), ("red",)), ("rings", "Rings", ("ring", r"\bgear"), ()), ("smalls", "Small things", ("^small",), ("gizmo",)))
_ENCODER = "CASE WHEN {0} = 'hyena_dna' OR starts_with({0}, 'hyena_dna_') THEN 'hyena_dna' WHEN {0} = 'dnabert2' OR starts_with({0}, 'dnabert2_') THEN 'dnabert2' WHEN {0} = 'gena_lm' OR starts_with({0}, 'gena_lm_') THEN 'gena_lm' WHEN {0} = 'nt_v2' OR starts_with({0}, 'nt_v2_') THEN 'nt_v2' END"
_SPLIT = "CASE WHEN row_number() OVER (PARTITION BY {s} ORDER BY md5({k}::VARCHAR || '|42'), {k}) <= floor(count(*) OVER (PARTITION BY {s}) * 0.7::DOUBLE) THEN 'train' WHEN row_number() OVER (PARTITION BY {s} ORDER BY md5({k}::VARCHAR || '|42'), {k}) <= floor(count(*) OVER (PARTITION BY {s}) * 0.85::DOUBLE) THEN 'val' ELSE 'test' END"
#: Latest classification and regression runs.
_LATEST = (
    cte("runs")
    + """,
lc AS (SELECT *, feature_source AS source, shuffled_labels AS shuffled FROM runs WHERE model = 'logistic_probe'
  QUALIFY row_number() OVER (PARTITION BY feature_source, task, shuffled_labels ORDER BY timestamp DESC, run_id DESC) = 1),
kr AS (SELECT *, CASE model WHEN 'kmer_baseline_4' THEN 'kmer' WHEN 'anti_baseline_shuffled_y' THEN 'shuffled_y:' || dataset WHEN 'linear_probe' THEN dataset END AS key FROM runs),
lr AS (SELECT * FROM kr WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY timestamp DESC, run_id DESC) = 1)"""
)
_POOL = "list_position(['base','meanmean','specialmean','meanD','meanG','maxmean','clsmean'], {0})"
_F5 = (
    _LATEST
    + f""",
enc AS (SELECT *, {_ENCODER.format('source')} AS e FROM lc WHERE task = 'family5' AND NOT shuffled),
b AS (SELECT max(test_macro_f1) AS f, max(test_kappa) AS k, max(test_accuracy) AS a FROM enc WHERE source = 'kmer'),
f5 AS (SELECT coalesce(e, source) AS encoder, CASE WHEN e = source THEN 'base' WHEN e IS NOT NULL THEN substr(source, length(e) + 2) ELSE 'baseline' END AS pooling, source AS feature_source,
  test_macro_f1, test_macro_f1 - b.f AS delta_f1_vs_4mer, test_kappa, test_kappa - b.k AS delta_kappa_vs_4mer, test_accuracy, test_accuracy - b.a AS delta_accuracy_vs_4mer, C, timestamp, e FROM enc, b),
best AS (SELECT * FROM f5 WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY e ORDER BY test_macro_f1 DESC NULLS LAST, coalesce({_POOL.format('pooling')}, 999), feature_source) = 1),
main5 AS (SELECT * EXCLUDE (e) FROM best UNION ALL BY NAME SELECT * EXCLUDE (e) FROM f5 WHERE feature_source = 'kmer' UNION ALL BY NAME
  SELECT source AS encoder, 'anti_baseline' AS pooling, source AS feature_source, test_macro_f1, test_macro_f1 - b.f AS delta_f1_vs_4mer, test_kappa, test_kappa - b.k AS delta_kappa_vs_4mer,
  test_accuracy, test_accuracy - b.a AS delta_accuracy_vs_4mer, C, timestamp FROM lc, b WHERE task = 'family5' AND shuffled AND source = 'shuffled')"""
)
_FEATURE = "CASE WHEN {0} = 'dataset.parquet' THEN 'dnabert2' WHEN {0} = 'dataset_nt_v2.parquet' THEN 'nt_v2' WHEN {0} LIKE 'dataset\\_%.parquet' ESCAPE '\\' THEN nullif(regexp_extract({0}, '^dataset_(.*)\\.parquet$', 1), '') END"
_REG = (
    f""",
cells AS (SELECT *, CASE WHEN key = 'kmer' THEN 'kmer' ELSE {_FEATURE.format('key')} END AS source FROM lr WHERE NOT starts_with(key, 'shuffled_y:')),
ctl AS (SELECT *, 'shuffled_y' AS source FROM lr WHERE starts_with(key, 'shuffled_y:') ORDER BY test_r2_macro DESC NULLS LAST, key LIMIT 1),
rr AS (SELECT *, {_ENCODER.format('source')} AS e FROM (SELECT * FROM cells WHERE source IS NOT NULL UNION ALL BY NAME SELECT * FROM ctl)),
reg AS (SELECT coalesce(e, source) AS encoder, CASE WHEN source = 'shuffled_y' THEN '-' WHEN e = source THEN 'base' WHEN e IS NOT NULL THEN substr(source, length(e) + 2) ELSE 'baseline' END AS pooling,
  source AS feature_source, test_r2_macro, test_r2_macro - (SELECT max(test_r2_macro) FROM cells WHERE key = 'kmer') AS delta_vs_4mer, test_mean_cosine, test_median_cosine, alpha, timestamp FROM rr),
mainr AS (SELECT * FROM reg WHERE encoder IN ('shuffled_y','kmer','dnabert2','nt_v2','gena_lm','hyena_dna')
  QUALIFY row_number() OVER (PARTITION BY encoder ORDER BY test_r2_macro DESC NULLS LAST, coalesce({_POOL.format('pooling')}, 999), feature_source) = 1)"""
)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return io.table(spark, d, name)


def _classification(spark, d):
    return ranking.latest_classification(spark_view(spark, d, "runs"))


def _regression(spark, d):
    return ranking.latest_regression(spark_view(spark, d, "runs"))


# scans, inspection, sources
@query("s2_describe_vectors", "SELECT count(*) AS n, min(len(embedding))::INT AS dim_min, max(len(embedding))::INT AS dim_max, CASE WHEN count(*) FILTER (regexp_full_match(vec_id::VARCHAR, '[A-Z0-9]+')) * 2 > count(*) THEN 'symbol' ELSE 'unknown' END AS key_format, (SELECT list_sort(list(v)) FROM (SELECT vec_id::VARCHAR AS v FROM embeddings ORDER BY vec_id LIMIT 10)) AS sample FROM embeddings")
def _(spark, d):
    return io.describe_vectors(_t(spark, d, "embeddings"), "vec_id", "embedding")


@query("s4_projected_scan", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en'")
def _(spark, d):
    return _t(spark, d, "documents").where("lang = 'en'").select("doc_id", "n_chars")


@query("s5_fasta_sequence", r"SELECT doc_id, md5(upper(regexp_replace(regexp_replace('>h' || chr(10) || replace(text, 'ß', 'SS'), '(?m)^\s*>.*$', '', 'g'), '\s+', '', 'g'))) AS seq_md5 FROM documents")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(sequence.fasta_sequence(F.concat(F.lit(">h\n"), "text"))).alias("seq_md5"))


@query("s7_json_field_version", "SELECT event_id, split_part(json_extract_string(props, '$.k'), '.', 1) AS k FROM events")
def _(spark, d):
    return _t(spark, d, "events").select("event_id", F.split_part(F.get_json_object("props", "$.k"), F.lit("."), F.lit(1)).alias("k"))


@query("s10_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
def _(spark, d):
    return incremental.pending(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id", ["quality"]).select("doc_id")


@query("s12_binary_manifest", "SELECT 'de_vs_fr' AS task, 42 AS seed, 'de' AS positive, 'fr' AS negative, count(*) FILTER (lang = 'de') AS n_per_class, list_sort(list(doc_id::VARCHAR) FILTER (lang = 'de')) AS positive_ids, list_sort(list(doc_id::VARCHAR) FILTER (lang = 'fr')) AS negative_ids FROM documents")
def _(spark, d):
    docs = _t(spark, d, "documents").withColumn("split", F.lit("train"))
    return io.binary_manifest(docs, "doc_id", "lang", "de", "fr", "de_vs_fr").drop("splits")


@query("s20_inspect", "SELECT count(*) AS n_rows, 5::BIGINT AS n_columns, min(length(text)) AS length_min, floor(median(length(text)))::BIGINT AS length_median, max(length(text)) AS length_max FROM documents")
def _(spark, d):
    return io.inspect(_t(spark, d, "documents"), text="text")


@query("s20_inspect_vectors", "SELECT count(*) AS n_rows, 3::BIGINT AS n_columns, min(n) AS norm_min, max(n) AS norm_max, 0::BIGINT AS n_nan FROM (SELECT sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)")
def _(spark, d):
    return io.inspect(_t(spark, d, "embeddings"), vector="embedding")


# predicates, filters, samples
_RULE = {n: f"regexp_matches(text, '(?i){'|'.join('(?:' + p + ')' for p in i)}')" + (f" AND NOT regexp_matches(text, '(?i){'|'.join('(?:' + p + ')' for p in x)}')" if x else "") for n, _, i, x in RULES}


@query("f1_rule_predicate", f"WITH {cte('genes')} SELECT id, ({_RULE['bolts']}) AS hit FROM genes")
def _(spark, d):
    return spark_view(spark, d, "genes").select("id", curation.matches(F.col("text"), RULES[0][2], RULES[0][3]).alias("hit"))


@query("f2_known_keys", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return curation.keep_known(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id")


@query("f4_head_per_group", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7")
def _(spark, d):
    return curation.head_per_group(_t(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 7)


@query("f5_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(25)


@query("f6_rename_drop_assign", "SELECT doc_id AS id, lang, length(text) AS n FROM documents")
def _(spark, d):
    return _t(spark, d, "documents").withColumnRenamed("doc_id", "id").withColumn("n", F.length("text").cast("long")).drop("text", "source", "n_chars")


@query("f7_funnel", f"WITH {cte('genes')} SELECT count(*) FILTER (id IS NOT NULL) AS all_rows, count(*) FILTER (regexp_matches(text, '(?i)bolt')) AS bolts, count(*) FILTER (regexp_matches(text, '(?i)bolt') AND grp < 'Brand#2') AS brand FROM genes")
def _(spark, d):
    return curation.funnel(spark_view(spark, d, "genes"), {"all_rows": F.col("id").isNotNull(), "bolts": F.col("text").rlike("(?i)bolt"), "brand": F.col("grp") < "Brand#2"})


@query("f8_least_length", "SELECT doc_id FROM documents WHERE length(coalesce(text, '')) >= 30")
def _(spark, d):
    return _t(spark, d, "documents").where(F.length(F.coalesce("text", F.lit(""))) >= 30).select("doc_id")


@query("f9_run_filter", f"WITH {cte('runs')} SELECT run_id FROM runs WHERE model = 'logistic_probe' AND task = 'family5' AND NOT coalesce(shuffled_labels, false)")
def _(spark, d):
    return spark_view(spark, d, "runs").where("model = 'logistic_probe' and task = 'family5' and not coalesce(shuffled_labels, false)").select("run_id")


@query("f10_name_parts", f"WITH {cte('runs')}, s AS (SELECT DISTINCT feature_source AS s, {_ENCODER.format('feature_source')} AS e FROM runs) SELECT s AS feature_source, e AS encoder, CASE WHEN s = e THEN 'base' WHEN e IS NOT NULL THEN substr(s, length(e) + 2) END AS pooling FROM s")
def _(spark, d):
    return spark_view(spark, d, "runs").select("feature_source").distinct().select("feature_source", names.encoder_of(F.col("feature_source")).alias("encoder"), names.pooling_of(F.col("feature_source")).alias("pooling"))


@query("f11_balanced_sample", "WITH n AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang)) SELECT doc_id, lang FROM documents, n WHERE lang IN ('de', 'fr') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) <= any_value(n.c) OVER ()")
def _(spark, d):
    return curation.balanced_sample(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", ["de", "fr"])


_DRAWS = "p AS (SELECT vec_id, {s} AS s, row_number() OVER (PARTITION BY {s} ORDER BY vec_id) - 1 AS n FROM preds), z AS (SELECT s, count(*) AS size FROM p GROUP BY s), dr AS (SELECT r AS rep, s, ('0x' || substr(md5('42|' || r || '|' || s || '|' || j), 1, 8))::BIGINT % size AS n FROM (SELECT s, size, unnest(range(size)) AS j FROM z), range({reps}) t(r)), w AS (SELECT rep, s, n, count(*) AS w FROM dr GROUP BY ALL), bw AS (SELECT rep, vec_id, w FROM w JOIN p USING (s, n))"


@query("f12_stratified_draws", f"WITH {cte('preds')}, {_DRAWS.format(s='t', reps=1000)} SELECT * FROM bw")
def _(spark, d):
    return models.stratified_draws(spark_view(spark, d, "preds"), "vec_id", "t", 1000)


@query("f13_draws", f"WITH {cte('preds')}, {_DRAWS.format(s=repr(''), reps=1000)} SELECT * FROM bw")
def _(spark, d):
    return models.stratified_draws(spark_view(spark, d, "preds"), "vec_id", None, 1000)


@query("f14_permuted_labels", "WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents), b AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS n FROM documents) SELECT doc_id, lang, b.source FROM a JOIN b USING (lang, n)")
def _(spark, d):
    return curation.permuted_labels(_t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", "source", "lang").select("doc_id", "lang", "source")


# joins, set operations
@query("j1_lookup_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    return curation.with_lookup(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id", "quality", -1)


@query("j2_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, d):
    return _t(spark, d, "orders").select("o_orderkey").join(_t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("j3_attach_by_id", "SELECT d.doc_id, len(e.embedding) AS dim FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").select("doc_id", F.size("embedding").cast("long").alias("dim"))


@query("j4_ordered_lookup", "SELECT row_number() OVER (ORDER BY vec_id DESC) - 1 AS pos, vec_id, label FROM embeddings")
def _(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    order = e.agg(F.reverse(F.array_sort(F.collect_list("vec_id"))).alias("ids")).select(F.posexplode("ids").alias("pos", "vec_id"))  # a manifest is one record
    return curation.ordered_lookup(order.withColumn("pos", F.col("pos").cast("long")), e, "vec_id")


@query("j5_three_way", "SELECT d.doc_id, l.quality, e.label FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id")
def _(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id").join(e, "doc_id")


@query("j6_aligned_pairs", "SELECT a.vec_id, a.label, b.embedding[1]::DOUBLE AS first FROM embeddings a JOIN embeddings b USING (vec_id)")
def _(spark, d):
    e = _t(spark, d, "embeddings")
    return curation.aligned_pairs(e.select("vec_id", "label"), e.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("first")), "vec_id")


@query("j7_membership", "SELECT doc_id, (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))::INT AS label FROM documents")
def _(spark, d):
    return curation.membership(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels").where("toxic = 1"), "doc_id").withColumn("label", F.col("label").cast("int"))


_KNN = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), k AS (SELECT q.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(q.e, b.e), 9) AS cosine, q.label AS ql, b.label AS nl, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, b.e) DESC, b.vec_id) AS rank FROM v q, v b WHERE q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id)"


def _knn(spark, d):
    e = _t(spark, d, "embeddings")
    return retrieval.neighbours(e, e.where("vec_id % 100 = 0"), 5)


@query("j8_cosine_neighbours", _KNN + " SELECT query, neighbour, cosine, rank FROM k WHERE rank <= 5")
def _(spark, d):
    return _knn(spark, d).withColumn("cosine", F.round("cosine", 9))


@query("g19_vote_agreement", _KNN + " SELECT query, count(*) FILTER (ql = nl) AS agree FROM k WHERE rank <= 5 GROUP BY query")
def _(spark, d):
    return retrieval.vote_agreement(_knn(spark, d), _t(spark, d, "embeddings"))


@query("j9_minus_baseline", f"WITH {_F5} SELECT feature_source, delta_f1_vs_4mer, delta_kappa_vs_4mer FROM f5")
def _(spark, d):
    return reports.family5(_classification(spark, d)).select("feature_source", "delta_f1_vs_4mer", "delta_kappa_vs_4mer")


@query("u1_union_by_name", "SELECT doc_id, lang FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def _(spark, d):
    x = _t(spark, d, "documents")
    return x.where("lang = 'de'").select("doc_id", "lang").unionByName(x.where("lang = 'fr'").select("lang", "doc_id"))


@query("u2_split_violations", "SELECT 'missing' AS problem, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return curation.split_violations(_t(spark, d, "labels").select("doc_id", F.lit("train").alias("split")), _t(spark, d, "documents"), "doc_id")


@query("u3_overlaps", "WITH x AS (SELECT DISTINCT l_suppkey AS k, l_returnflag AS g FROM lineitem) SELECT a.g AS a, b.g AS b, count(*) AS n FROM x a JOIN x b ON a.k = b.k AND a.g < b.g GROUP BY ALL")
def _(spark, d):
    return curation.overlaps(_t(spark, d, "lineitem"), "l_suppkey", "l_returnflag")


# priority assignment, splits
@query("a1_first_rule_wins", f"WITH {cte('genes')} SELECT id, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _RULE.items()) + " END AS family FROM genes")
def _(spark, d):
    return spark_view(spark, d, "genes").select("id", curation.assign(F.col("text"), RULES).alias("family"))


@query(
    "a1_capped_rules",
    f"WITH {cte('genes')}, a AS (SELECT id, 'bolts' AS family FROM genes WHERE {_RULE['bolts']} ORDER BY id LIMIT 50), b AS (SELECT id, 'rings' AS family FROM genes WHERE {_RULE['rings']} AND id NOT IN (SELECT id FROM a) ORDER BY id LIMIT 50), c AS (SELECT id, 'smalls' AS family FROM genes WHERE {_RULE['smalls']} AND id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b) ORDER BY id LIMIT 50) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c",
)
def _(spark, d):
    return curation.assign_capped(spark_view(spark, d, "genes"), "id", "text", "id", RULES, 50).select("id", "family")


_DOC_SPLIT = _SPLIT.format(s="lang", k="doc_id")


@query("a2_stratified_split", f"SELECT doc_id, lang, {_DOC_SPLIT} AS split FROM documents")
def _(spark, d):
    return curation.stratified_split(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query("a3_binary_subset", f"WITH n AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang)), s AS (SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS p FROM documents WHERE lang IN ('de', 'fr')), n WHERE p <= c) SELECT doc_id, lang, {_DOC_SPLIT} AS split FROM s")
def _(spark, d):
    return curation.stratified_split(curation.balanced_sample(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", ["de", "fr"]), "doc_id", "lang")


@query("a4_split_balance", f"WITH s AS (SELECT doc_id, lang, {_DOC_SPLIT} AS split, (lang = 'en')::INT AS y FROM documents) SELECT split, count(DISTINCT y) AS n_classes, avg(y::DOUBLE) AS positive, avg(y::DOUBLE) BETWEEN 0.45 AND 0.55 AS balanced FROM s GROUP BY split")
def _(spark, d):
    s = curation.stratified_split(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang")
    return curation.split_balance(s.withColumn("y", (F.col("lang") == "en").cast("int")), "y")


_COMPOSITION = f"WITH s AS (SELECT lang, {_DOC_SPLIT} AS split FROM documents), o AS (SELECT unnest(['en', 'fr', 'de', 'es', 'it']) AS lang) SELECT o.lang, count(split) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM o LEFT JOIN s USING (lang) GROUP BY o.lang"


@query("a5_composition", _COMPOSITION)
def _(spark, d):
    s = curation.stratified_split(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang")
    return curation.composition(s, "lang", "split", ["en", "fr", "de", "es", "it"])


QUERIES["r1_dataset_composition"], SQL["r1_dataset_composition"] = QUERIES["a5_composition"], _COMPOSITION


# metrics
_SCORES = f"{cte('preds')}, c AS (SELECT t AS class FROM preds UNION SELECT p FROM preds), s AS (SELECT class, (SELECT count(*) FROM preds WHERE t = class) AS support, (SELECT count(*) FROM preds WHERE p = class) AS predicted, (SELECT count(*) FROM preds WHERE t = class AND p = class) AS hits FROM c), f AS (SELECT *, hits / nullif(support, 0) AS recall, coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1 FROM s)"


@query("g1_value_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("g2_confusion", f"WITH {cte('preds')}, c AS (SELECT DISTINCT t FROM preds) SELECT a.t AS true, b.t AS pred, (SELECT count(*) FROM preds x WHERE x.t = a.t AND x.p = b.t) AS n FROM c a, c b")
def _(spark, d):
    return metrics.confusion(spark_view(spark, d, "preds"), "t", "p")


@query("g6_class_scores", f"WITH {_SCORES} SELECT class, support, predicted, hits, recall, f1 FROM f")
def _(spark, d):
    return metrics.class_scores(spark_view(spark, d, "preds"), "t", "p")


@query("g8_summary", f"WITH {_SCORES}, x AS (SELECT sum(support)::BIGINT AS n, sum(hits) / sum(support) AS po, sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support)) AS pe, avg(recall) AS balanced_accuracy, avg(f1) AS macro_f1 FROM f) SELECT n, po::DOUBLE AS accuracy, balanced_accuracy, macro_f1, ((po - pe) / (1 - pe))::DOUBLE AS kappa FROM x")
def _(spark, d):
    return metrics.summary(spark_view(spark, d, "preds"), "t", "p")


@query("g9_kappa_fallback", f"WITH {_LATEST}, s AS (SELECT DISTINCT task, source AS label, 0.25::DOUBLE AS v FROM lc) SELECT lc.task, lc.source, lc.shuffled, coalesce(lc.test_kappa, s.v) AS test_kappa FROM lc LEFT JOIN s ON lc.task = s.task AND lc.source = s.label")
def _(spark, d):
    c = _classification(spark, d)
    known = c.select("task", F.col("source").alias("label"), F.lit(0.25).alias("value")).distinct()
    return reports.with_kappa(c, summary=known).select("task", "source", "shuffled", "test_kappa")


@query("g10_row_normalised", f"WITH {cte('preds')}, c AS (SELECT DISTINCT t FROM preds), m AS (SELECT a.t AS k, b.t AS pred, (SELECT count(*) FROM preds x WHERE x.t = a.t AND x.p = b.t) AS n FROM c a, c b) SELECT k AS true, pred, n, n / greatest(sum(n) OVER (PARTITION BY k), 1) AS share FROM m")
def _(spark, d):
    return metrics.row_normalised(metrics.confusion(spark_view(spark, d, "preds"), "t", "p"))


def _halves(spark, d):
    e = F.transform("e", lambda v: v.cast("double"))
    return spark_view(spark, d, "pairs").select("vec_id", F.slice(e, 1, 32).alias("y"), F.slice(e, 33, 32).alias("p"))


@query("g11_row_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]), 9) AS cosine FROM embeddings")
def _(spark, d):
    return models.row_cosines(_halves(spark, d)).select("vec_id", F.round("cosine", 9).alias("cosine"))


@query("g12_cosine_summary", "WITH c AS (SELECT list_cosine_similarity(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]) AS c FROM embeddings) SELECT round(avg(c), 9) AS mean, round(median(c), 9) AS median FROM c")
def _(spark, d):
    return models.row_cosines(_halves(spark, d)).agg(F.round(F.avg("cosine"), 9).alias("mean"), F.round(F.median("cosine"), 9).alias("median"))


_R2 = "x AS (SELECT i - 1 AS dim, embedding[i]::DOUBLE AS y, embedding[i]::DOUBLE - embedding[i + 32]::DOUBLE AS e FROM embeddings, range(1, 33) t(i)), r AS (SELECT dim, 1 - sum(e * e) / greatest(sum(y * y) - sum(y) * sum(y) / count(*), 1e-12) AS r2 FROM x GROUP BY dim)"


@query("g13_r2_by_dimension", f"WITH {_R2} SELECT dim, round(r2, 8) AS r2 FROM r")
def _(spark, d):
    return metrics.r2_by_dimension(_halves(spark, d), "y", "p").select(F.col("dim").cast("long").alias("dim"), F.round("r2", 8).alias("r2"))


_DIST = f"WITH {_R2} SELECT count(*) AS dims, round(avg(r2), 8) AS mean, round(median(r2), 8) AS median, count(*) FILTER (r2 > 0) AS above_0, count(*) FILTER (r2 > 0.5) AS above_05, round(max(r2), 8) AS max, round(quantile_cont(r2, 0.1), 8) AS p10, round(quantile_cont(r2, 0.9), 8) AS p90, (SELECT coalesce(min(k) FILTER (t > 0 AND c >= 0.5 * t), -1) FROM (SELECT row_number() OVER w AS k, sum(r2) OVER w AS c, sum(r2) OVER () AS t FROM r WINDOW w AS (ORDER BY r2 DESC, dim))) AS dims_half FROM r"


@query("g14_r2_distribution", _DIST)
def _(spark, d):
    out = metrics.r2_distribution(metrics.r2_by_dimension(_halves(spark, d), "y", "p"))
    return out.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


QUERIES["r13_per_dim_summary"], SQL["r13_per_dim_summary"] = QUERIES["g14_r2_distribution"], _DIST


@query("g16_interval", "SELECT source, quantile_cont(n_chars, 0.025)::DOUBLE AS lo, quantile_cont(n_chars, 0.975)::DOUBLE AS hi FROM documents GROUP BY source")
def _(spark, d):
    return metrics.interval(_t(spark, d, "documents"), "n_chars", ["source"])


@query("g17_pooling_matrix", f"WITH {_F5} SELECT encoder, " + ", ".join(f"max(test_macro_f1) FILTER (pooling = '{p}') AS \"{p}\"" for p in names.POOLING_ORDER) + " FROM f5 WHERE e IS NOT NULL GROUP BY encoder")
def _(spark, d):
    return reports.pooling_matrix(_classification(spark, d))


@query("g18_length_summary", "SELECT count(text) AS n, floor(median(length(text)))::BIGINT AS median, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents")
def _(spark, d):
    return metrics.length_summary(_t(spark, d, "documents"), "text")


@query("g20_column_maxima", f"WITH {_F5}, l AS (SELECT feature_source, unnest(['test_macro_f1', 'test_kappa', 'test_accuracy']) AS metric, unnest([test_macro_f1, test_kappa, test_accuracy]) AS value FROM f5) SELECT metric, feature_source, value FROM l WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, feature_source) = 1")
def _(spark, d):
    return ranking.column_maxima(reports.family5(_classification(spark, d)), "feature_source", ["test_macro_f1", "test_kappa", "test_accuracy"])


@query("g21_gate", f"WITH {_F5} SELECT feature_source, delta_f1_vs_4mer, CASE WHEN delta_f1_vs_4mer >= 0.02::DOUBLE THEN 'win' WHEN delta_f1_vs_4mer <= -0.02::DOUBLE THEN 'loss' WHEN delta_f1_vs_4mer IS NOT NULL THEN 'tie' END AS gate FROM f5")
def _(spark, d):
    return reports.gate_table(_classification(spark, d))


@query("g22_best_regression_cell", f"WITH {_LATEST}{_REG} SELECT feature_source, test_r2_macro FROM reg WHERE encoder <> 'shuffled_y' ORDER BY test_r2_macro DESC, feature_source LIMIT 1")
def _(spark, d):
    return reports.regression_full(_regression(spark, d)).where("encoder <> 'shuffled_y'").orderBy(F.desc("test_r2_macro"), "feature_source").limit(1).select("feature_source", "test_r2_macro")


@query("g23_histogram", "WITH b AS (SELECT least(floor((value - 0) / 12.5::DOUBLE), 39)::BIGINT AS bin FROM events WHERE value BETWEEN 0 AND 500) SELECT r AS bin, (SELECT count(*) FROM b WHERE bin = r) AS n FROM range(40) t(r)")
def _(spark, d):
    return metrics.histogram(_t(spark, d, "events"), "value", 0.0, 500.0, 40)


# latest, best, order
_RUN = "source, task, shuffled, run_id, test_macro_f1"


@query("w1_latest_classification", f"WITH {_LATEST} SELECT {_RUN} FROM lc")
def _(spark, d):
    return _classification(spark, d).select(*_RUN.split(", "))


@query("w2_latest_regression", f"WITH {_LATEST} SELECT key, run_id, test_r2_macro FROM lr")
def _(spark, d):
    return _regression(spark, d).select("key", "run_id", "test_r2_macro")


@query("w3_best_source_vs_baseline", f"WITH {_F5} SELECT * EXCLUDE (e) FROM best")
def _(spark, d):
    return reports.best_family5(_classification(spark, d))


@query("w5_best_control", f"WITH {_LATEST}{_REG} SELECT encoder, pooling, test_r2_macro, delta_vs_4mer FROM reg WHERE encoder = 'shuffled_y'")
def _(spark, d):
    return reports.regression_full(_regression(spark, d)).where("encoder = 'shuffled_y'").select("encoder", "pooling", "test_r2_macro", "delta_vs_4mer")


@query("w7_paper_order", f"WITH {_F5} SELECT feature_source, row_number() OVER (ORDER BY coalesce(list_position(['dnabert2','nt_v2','gena_lm','hyena_dna'], encoder), 999), coalesce({_POOL.format('pooling')}, 999), feature_source) AS place FROM f5 WHERE e IS NOT NULL")
def _(spark, d):
    from pyspark.sql import Window

    rows = reports.pooling_sweep(_classification(spark, d))
    order = [names.rank_of(F.col("encoder"), tuple(e[0] for e in names.ENCODERS)), names.rank_of(F.col("pooling"), names.POOLING_ORDER), F.col("feature_source")]
    return rows.select("feature_source", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("w9_extremes", "(SELECT doc_id, 'longest' AS cohort FROM documents ORDER BY length(text) DESC, doc_id LIMIT 2) UNION ALL (SELECT doc_id, 'shortest' AS cohort FROM documents ORDER BY length(text), doc_id LIMIT 2)")
def _(spark, d):
    return ranking.extremes(_t(spark, d, "documents"), F.length("text"), 2, ["doc_id"]).select("doc_id", "cohort")


@query("w10_best_pool_by_task", f"WITH {_LATEST}, x AS (SELECT *, {_ENCODER.format('source')} AS e FROM lc WHERE NOT shuffled) SELECT task, source, test_macro_f1 FROM x WHERE e = 'nt_v2' QUALIFY row_number() OVER (PARTITION BY task ORDER BY test_macro_f1 DESC NULLS LAST, source) = 1")
def _(spark, d):
    rows = _classification(spark, d).where(~F.col("shuffled") & (names.encoder_of(F.col("source")) == "nt_v2"))
    return ranking.best(rows, ["task"], "test_macro_f1", [F.col("source")]).select("task", "source", "test_macro_f1")


# sequences
@query("q1_kmer_counts", f"WITH {cte('seqs')}, u AS (SELECT doc_id, substr(seq, i, 4) AS kmer FROM (SELECT doc_id, upper(seq) AS seq, unnest(range(1, greatest(length(seq) - 2, 1))) AS i FROM seqs)) SELECT doc_id, kmer, count(*) AS n FROM u WHERE regexp_full_match(kmer, '[ACGT]{{4}}') GROUP BY ALL")
def _(spark, d):
    return sequence.kmer_counts(spark_view(spark, d, "seqs"), "doc_id", "seq")


@query("q1_kmer_frequencies", f"WITH {cte('seqs')}, u AS (SELECT doc_id, substr(seq, i, 4) AS kmer FROM (SELECT doc_id, upper(seq) AS seq, unnest(range(1, greatest(length(seq) - 2, 1))) AS i FROM seqs)), c AS (SELECT doc_id, kmer, count(*) AS n FROM u WHERE regexp_full_match(kmer, '[ACGT]{{4}}') GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS s FROM c GROUP BY 1) SELECT doc_id, (list_position(['A','C','G','T'], kmer[1]) - 1) * 64 + (list_position(['A','C','G','T'], kmer[2]) - 1) * 16 + (list_position(['A','C','G','T'], kmer[3]) - 1) * 4 + list_position(['A','C','G','T'], kmer[4]) - 1 AS k, n / s AS share FROM c JOIN t USING (doc_id)")
def _(spark, d):
    x = sequence.kmer_frequencies(spark_view(spark, d, "seqs"), "doc_id", "seq")
    return x.select("doc_id", F.posexplode("x").alias("k", "share")).where("share > 0").select("doc_id", F.col("k").cast("long").alias("k"), "share")


@query("q2_split_features", f"WITH {cte('seqs')} SELECT {_SPLIT.format(s='lang', k='doc_id')} AS split, doc_id, regexp_matches(seq, '[ACGT]{{4}}') AS any_kmer FROM seqs")
def _(spark, d):
    seqs = spark_view(spark, d, "seqs")
    manifest = curation.stratified_split(seqs.select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "split", F.col("doc_id").alias("pos"))
    x = sequence.split_features(manifest, seqs, "doc_id", "seq")
    return x.select("split", "doc_id", F.exists("x", lambda v: v > 0).alias("any_kmer"))


@query("q3_log_length", f"WITH {cte('seqs')} SELECT doc_id, round(ln(1 + length(seq)), 9) AS x FROM seqs")
def _(spark, d):
    return spark_view(spark, d, "seqs").select("doc_id", F.round(sequence.log_length(F.col("seq")), 9).alias("x"))


@query("q4_chunk_windows", "WITH x AS (SELECT doc_id, length(text) AS n FROM documents), y AS (SELECT doc_id, n, CASE WHEN n <= 510 THEN [0] ELSE range(0, (ceil((n - 510) / 446) * 446)::BIGINT + 1, 446) END AS s FROM x) SELECT doc_id, unnest(range(len(s))) AS chunk_no, unnest(s) AS start, least(510, n - unnest(s)) AS len FROM y")
def _(spark, d):
    out = sequence.chunks(_t(spark, d, "documents"), "doc_id", F.length("text"), 510, 64)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_no", "start", "len")])


@query("q5_centre_fit", "SELECT doc_id, md5(CASE WHEN n >= 1000 THEN substr(text, (n - 1000) // 2 + 1, 1000) ELSE repeat('N', (1000 - n) // 2) || text || repeat('N', 1000 - n - (1000 - n) // 2) END) AS fit FROM (SELECT doc_id, text, length(text) AS n FROM documents)")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(sequence.centre_fit(F.col("text"), 1000)).alias("fit"))


_BASES = " - ".join(f"{4 - k} * (length(seq) - length(replace(seq, '{b}', '')))" for k, b in enumerate("ACGT"))


@query("q6_base_indices", f"WITH {cte('seqs')} SELECT doc_id, (4 * length(seq) - {_BASES})::BIGINT AS s FROM seqs")
def _(spark, d):
    idx = sequence.base_indices(F.col("seq"))
    return spark_view(spark, d, "seqs").select("doc_id", F.aggregate(idx, F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))


@query("q7_centre_slice", "SELECT vec_id, round(list_sum(embedding[29:36]::DOUBLE[]), 6) AS s FROM embeddings")
def _(spark, d):
    c = F.transform(sequence.centre_slice(F.col("embedding"), 8), lambda v: v.cast("double"))
    return _t(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


_TSS = "greatest(CASE WHEN strand >= 0 THEN lo ELSE hi END - 500, 1)"


@query("q8_tss_window", f"WITH {cte('coords')} SELECT l_orderkey, l_linenumber, {_TSS} AS win_start, {_TSS} + 1000 AS win_end, chrom || ':' || {_TSS} || '..' || ({_TSS} + 1000) || ':1' AS region FROM coords")
def _(spark, d):
    c = spark_view(spark, d, "coords")
    low, high = sequence.tss_window(F.col("lo"), F.col("hi"), F.col("strand"), 1001)
    return c.select("l_orderkey", "l_linenumber", low.alias("win_start"), high.alias("win_end"), sequence.region_name(F.col("chrom"), low, high).alias("region"))


@query("q10_excerpt", "SELECT doc_id, replace(CASE WHEN length(t) > 80 THEN left(t, 80) || '...' ELSE t END, '|', '/') AS x FROM (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM documents)")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", sequence.excerpt(F.col("text"), 80).alias("x"))


@query("q12_names", f"WITH {cte('runs')}, x AS (SELECT DISTINCT dataset, feature_source FROM runs) SELECT dataset, feature_source, {_FEATURE.format('dataset')} AS feature_of, CASE WHEN feature_source IN ('kmer', 'shuffled') THEN NULL WHEN feature_source = 'dnabert2' THEN 'dataset.parquet' ELSE 'dataset_' || feature_source || '.parquet' END AS dataset_of FROM x")
def _(spark, d):
    x = spark_view(spark, d, "runs").select("dataset", "feature_source").distinct()
    return x.select("dataset", "feature_source", names.feature_of(F.col("dataset")).alias("feature_of"), names.dataset_of(F.col("feature_source")).alias("dataset_of"))


@query("q13_registry", "WITH e AS (SELECT unnest(['dnabert2','nt_v2','gena_lm','hyena_dna']) AS encoder), v AS (SELECT unnest(['base','meanmean','specialmean','meanD','meanG','maxmean','clsmean']) AS pooling) SELECT CASE WHEN pooling = 'base' THEN encoder ELSE encoder || '_' || pooling END AS feature_source, encoder, pooling FROM e, v UNION ALL VALUES ('kmer', 'kmer', 'baseline'), ('shuffled', 'shuffled', 'baseline')")
def _(spark, d):
    return names.feature_sources(spark)


@query("q14_number_format", "SELECT event_id, printf('%+.4f', value) AS signed, printf('%.4f', value) AS plain FROM events")
def _(spark, d):
    return _t(spark, d, "events").select("event_id", sequence.signed4(F.col("value")).alias("signed"), sequence.fixed4(F.col("value")).alias("plain"))


# vectors
_POOLED = "x AS (SELECT label, vec_id, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), d AS (SELECT label, i, avg(v) AS mean_v, max(v) AS max_v, arg_min(v, vec_id) AS first_v, arg_max(v, vec_id) AS last_v FROM x GROUP BY label, i)"


def _pooled(spark, d):
    return vector.pooled(_t(spark, d, "embeddings"), "label", "embedding", "vec_id")


@query("v1_mean_pool", f"WITH {_POOLED} SELECT label, i - 1 AS i, round(mean_v, 8) AS v FROM d")
def _(spark, d):
    return _pooled(spark, d).select("label", F.posexplode("mean_vec").alias("i", "v")).select("label", F.col("i").cast("long").alias("i"), F.round("v", 8).alias("v"))


_PARTS = "SELECT label, 64 * {k} + i - 1 AS i, round({c}, 8) AS v FROM d"


@query("v5_mean_d", f"WITH {_POOLED} " + " UNION ALL ".join(_PARTS.format(k=k, c=c) for k, c in enumerate(("first_v", "last_v", "mean_v"))))
def _(spark, d):
    p = _pooled(spark, d)
    return p.select("label", F.posexplode(vector.mean_d(p)).alias("i", "v")).select("label", F.col("i").cast("long").alias("i"), F.round("v", 8).alias("v"))


@query("v6_mean_g", f"WITH {_POOLED} " + " UNION ALL ".join(_PARTS.format(k=k, c=c) for k, c in enumerate(("first_v", "last_v", "mean_v", "max_v"))))
def _(spark, d):
    p = _pooled(spark, d)
    return p.select("label", F.posexplode(vector.mean_g(p)).alias("i", "v")).select("label", F.col("i").cast("long").alias("i"), F.round("v", 8).alias("v"))


@query("v10_token_reductions", "WITH x AS (SELECT label, vec_id % 2 = 0 AS even, i - 1 AS i, vec_id, embedding[i]::DOUBLE AS v, row_number() OVER (PARTITION BY label, i ORDER BY vec_id) - 1 AS pos FROM embeddings, range(1, 65) t(i)) SELECT label, i, round(avg(v) FILTER (pos > 0), 8) AS mean, round(avg(v), 8) AS special_mean, round(max(v) FILTER (pos > 0), 8) AS max, round(max(v) FILTER (pos = 0), 8) AS cls FROM x GROUP BY label, i")
def _(spark, d):
    from pyspark.sql import Window

    e = _t(spark, d, "embeddings").select("label", F.col("embedding").alias("vec"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("pos"))
    r = vector.token_reductions(e.withColumn("special", F.col("pos") == 0), ["label"])
    z = r.select("label", F.posexplode(F.arrays_zip("mean", "special_mean", "max", "cls")).alias("i", "e"))
    return z.select("label", F.col("i").cast("long").alias("i"), *[F.round(F.col(f"e.{c}"), 8).alias(c) for c in ("mean", "special_mean", "max", "cls")])


@query("v9_variant_dataset", f"WITH {_POOLED} SELECT label, 192::BIGINT AS width, round(sum(mean_v) + sum(first_v) + sum(last_v), 6) AS s FROM d GROUP BY label")
def _(spark, d):
    p = _pooled(spark, d)
    features = _t(spark, d, "embeddings").select("label").distinct().withColumn("x", F.array(F.lit(0.0)))
    out = vector.variant_dataset(features, p.select("label", vector.mean_d(p).alias("x")), "label", "meanD", 64)
    return out.select("label", F.size("x").cast("long").alias("width"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("s"))


@query("v11_flat_mean", "WITH x AS (SELECT label, vec_id % 7 AS c, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), c AS (SELECT label, c, i, avg(v) AS v FROM x GROUP BY ALL) SELECT label, i - 1 AS i, round(avg(v), 8) AS v FROM c GROUP BY label, i")
def _(spark, d):
    e = _t(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("chunk_no"), F.col("embedding").alias("vec"))
    return vector.flat_mean(e, "label").select("label", F.posexplode("x").alias("i", "v")).select("label", F.col("i").cast("long").alias("i"), F.round("v", 8).alias("v"))


@query("v12_bin_means", "WITH b AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings), x AS (SELECT label, i, embedding[i]::DOUBLE AS v, k >= greatest(floor((n - 4) / 2), 0) AND k < greatest(floor((n - 4) / 2), 0) + 4 AS c FROM b, range(1, 65) t(i)) SELECT label, i - 1 AS i, round(avg(v), 8) AS g, round(avg(v) FILTER (c), 8) AS c FROM x GROUP BY label, i")
def _(spark, d):
    e = _t(spark, d, "embeddings").select("label", F.col("vec_id").alias("bin"), F.col("embedding").alias("vec"))
    z = vector.bin_means(e, "label", 4).select("label", F.posexplode(F.arrays_zip("global_vec", "centre_vec")).alias("i", "e"))
    return z.select("label", F.col("i").cast("long").alias("i"), F.round("e.global_vec", 8).alias("g"), F.round("e.centre_vec", 8).alias("c"))


@query("v13_normalised", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 8) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 8) AS first FROM embeddings")
def _(spark, d):
    e = F.col("embedding")
    return _t(spark, d, "embeddings").select("vec_id", F.round(vector.norm(e), 8).alias("norm"), F.round(F.get(e, F.lit(0)).cast("double") / F.greatest(vector.norm(e), F.lit(vector.TINY)), 8).alias("first"))


@query("v14_dot", "SELECT vec_id, round(list_dot_product(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]), 8) AS dot FROM embeddings")
def _(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(vector.dot(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), 8).alias("dot"))


@query("v15_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS cls FROM embeddings")
def _(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", vector.argmax(F.col("embedding"), F.sequence(F.lit(0), F.lit(63))).cast("long").alias("cls"))


@query("v16_two_components")
def _(spark, d):
    return models.project_2d(_t(spark, d, "embeddings"), "embedding").select("vec_id", "xy")


# models
def _xy(spark, d):
    s = curation.stratified_split(_t(spark, d, "embeddings"), "vec_id", "label")
    e = F.transform("embedding", lambda v: v.cast("double"))
    return s.select("vec_id", "label", "split", F.slice(e, 1, 48).alias("x"), F.slice(e, 49, 16).alias("y"))


@query("m1_ridge_single", "SELECT round(regr_slope(y, x), 6) AS w, round(regr_intercept(y, x), 6) AS b FROM (SELECT embedding[1]::DOUBLE AS x, embedding[49]::DOUBLE AS y FROM embeddings)")
def _(spark, d):
    e = _xy(spark, d).select(F.slice("x", 1, 1).alias("x"), F.slice("y", 1, 1).alias("y"))
    w, b = models.gram(e).ridge(0.0)
    return spark.createDataFrame([(round(float(w[0, 0]), 6), round(float(b[0]), 6))], "w double, b double")


@query("m2_ridge_protocol")
def _(spark, d):
    return models.ridge_protocol(_xy(spark, d))


@query("m3_logistic_protocol")
def _(spark, d):
    return models.logistic_protocol(_xy(spark, d).withColumn("label", (F.col("label") % 2).cast("int")))


@query("m6_mlp_protocol")
def _(spark, d):
    return models.mlp_protocol(_xy(spark, d).withColumn("id", F.col("vec_id")), models.MLP_CONFIGS)


@query("m8_shuffled_control")
def _(spark, d):
    xy = _xy(spark, d)
    control = curation.permuted_labels(xy.where("split <> 'test'"), "vec_id", "y", "split")
    return models.ridge_protocol(control.unionByName(xy.where("split = 'test'")))


_BOOT = f"{cte('preds')}, {_DRAWS.format(s='t', reps=1000)}, d AS (SELECT rep, t, p, w FROM bw JOIN preds USING (vec_id)), c AS (SELECT rep, t AS class FROM d UNION SELECT rep, p FROM d), su AS (SELECT rep, t AS class, sum(w) AS s, sum(w) FILTER (t = p) AS h FROM d GROUP BY ALL), pr AS (SELECT rep, p AS class, sum(w) AS q FROM d GROUP BY ALL), zz AS (SELECT rep, class, coalesce(s, 0) AS s, coalesce(q, 0) AS q, coalesce(h, 0) AS h FROM c LEFT JOIN su USING (rep, class) LEFT JOIN pr USING (rep, class)), m AS (SELECT rep, avg(coalesce(2 * h / nullif(s + q, 0), 0)) AS macro_f1, (sum(h) / sum(s) - sum(s::DOUBLE * q) / (sum(s)::DOUBLE * sum(s))) / (1 - sum(s::DOUBLE * q) / (sum(s)::DOUBLE * sum(s))) AS kappa FROM zz GROUP BY rep)"


@query("m9_bootstrap_classification", f"WITH {_BOOT} SELECT 'macro_f1' AS metric, round(quantile_cont(macro_f1, 0.025), 9) AS lo, round(quantile_cont(macro_f1, 0.975), 9) AS hi FROM m UNION ALL SELECT 'kappa', round(quantile_cont(kappa, 0.025), 9), round(quantile_cont(kappa, 0.975), 9) FROM m")
def _(spark, d):
    out = models.bootstrap_classification(spark_view(spark, d, "preds"), "vec_id", "t", "p")
    return out.select("metric", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query("m10_bootstrap_regression", f"WITH {cte('preds')}, {_DRAWS.format(s=repr(''), reps=1000)}, x AS (SELECT rep, i, w::DOUBLE AS w, embedding[i]::DOUBLE AS y, embedding[i]::DOUBLE - embedding[i + 32]::DOUBLE AS e FROM bw JOIN embeddings USING (vec_id), range(1, 33) t(i)), r AS (SELECT rep, i, 1 - sum(w * e * e) / greatest(sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w), 1e-12) AS r2 FROM x GROUP BY rep, i), v AS (SELECT rep, avg(r2) AS v FROM r GROUP BY rep) SELECT 'r2_macro' AS metric, round(quantile_cont(v, 0.025), 8) AS lo, round(quantile_cont(v, 0.975), 8) AS hi FROM v")
def _(spark, d):
    out = models.bootstrap_regression(_halves(spark, d), "vec_id", "y", "p")
    return out.select("metric", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


def _letters(texts: list[str]) -> np.ndarray:
    """A stand-in for a pretrained encoder: shares of the four bases."""
    return np.array([[(t or "").count(b) / max(1, len(t or "")) for b in sequence.BASES] for t in texts]).reshape(len(texts), 4)


@query("m11_plugged_encoder", f"WITH {cte('seqs')} SELECT doc_id, round((length(seq) - length(replace(seq, 'A', ''))) / greatest(length(seq), 1), 9) AS a FROM seqs")
def _(spark, d):
    out = models.encode(spark_view(spark, d, "seqs"), "doc_id", "seq", _letters, 4)
    return out.select("doc_id", F.round(F.get("x", F.lit(0)), 9).alias("a"))


@query("m12_skip_existing", f"WITH {_LATEST}, e AS (SELECT unnest(['dnabert2','nt_v2','gena_lm','hyena_dna']) AS encoder), v AS (SELECT unnest(['base','meanmean','specialmean','meanD','meanG','maxmean','clsmean']) AS pooling), w AS (SELECT CASE WHEN pooling = 'base' THEN encoder ELSE encoder || '_' || pooling END AS feature_source FROM e, v) SELECT feature_source FROM w WHERE feature_source NOT IN (SELECT source FROM lc WHERE task = 'family5')")
def _(spark, d):
    done = _classification(spark, d).where("task = 'family5'").select(F.col("source").alias("feature_source"))
    return incremental.skip_existing(names.feature_sources(spark, baselines=False).select("feature_source"), done, ["feature_source"])


# report tables
@query("r2_main_family5", f"WITH {_F5} SELECT * FROM main5")
def _(spark, d):
    return reports.main_family5(_classification(spark, d))


@query("r3_pooling_sweep", f"WITH {_F5} SELECT * EXCLUDE (e) FROM f5 WHERE e IS NOT NULL")
def _(spark, d):
    return reports.pooling_sweep(_classification(spark, d))


@query("r4_regression_full", f"WITH {_LATEST}{_REG} SELECT * FROM reg")
def _(spark, d):
    return ranking.in_paper_order(reports.regression_full(_regression(spark, d)))


@query("r5_main_regression", f"WITH {_LATEST}{_REG} SELECT * FROM mainr")
def _(spark, d):
    return reports.main_regression(_regression(spark, d))


@query("r6_combined_summary", f"WITH {_F5}{_REG} SELECT encoder, f.feature_source AS family5_feature_source, f.test_macro_f1 AS family5_macro_f1, f.test_kappa AS family5_kappa, f.test_accuracy AS family5_accuracy, r.feature_source AS regression_feature_source, r.test_r2_macro AS ridge_r2_macro, r.delta_vs_4mer AS ridge_delta_vs_4mer FROM main5 f FULL JOIN mainr r USING (encoder)")
def _(spark, d):
    return reports.combined_summary(reports.main_family5(_classification(spark, d)), reports.main_regression(_regression(spark, d)))


_SPEC = ", ".join(str(row) for row in reports.CONTEXT)


@query("r7_context_ablation", f"WITH {_LATEST}, spec(label, context, model_group, f, dataset, r) AS (VALUES {_SPEC}), q AS (SELECT regexp_replace(key, '^data/', '') AS dataset, test_r2_macro, starts_with(key, 'data/') AS far FROM lr QUALIFY row_number() OVER (PARTITION BY regexp_replace(key, '^data/', '') ORDER BY starts_with(key, 'data/')) = 1), c AS (SELECT * FROM lc WHERE task = 'family5' AND NOT shuffled) SELECT label, context, model_group, f AS family5_feature_source, r AS regression_feature_source, c.test_macro_f1 AS family5_macro_f1, c.test_kappa AS family5_kappa, c.test_accuracy AS family5_accuracy, q.test_r2_macro AS ridge_r2_macro FROM spec LEFT JOIN c ON c.source = f LEFT JOIN q ON q.dataset = spec.dataset")
def _(spark, d):
    return reports.context_ablation(_classification(spark, d), _regression(spark, d))


@query("r8_legacy_binary", f"WITH {_LATEST}, x AS (SELECT *, {_ENCODER.format('source')} AS e FROM lc WHERE task IN ('tf_vs_gpcr', 'tf_vs_kinase')) SELECT task, coalesce(e, source) AS encoder, CASE WHEN e = source THEN 'base' WHEN e IS NOT NULL THEN substr(source, length(e) + 2) ELSE 'baseline' END AS pooling, source AS feature_source, test_macro_f1, test_kappa, test_accuracy, C, shuffled AS shuffled_labels FROM x")
def _(spark, d):
    return reports.legacy_binary(_classification(spark, d))


@query("r9_missing_cells", f"WITH {_LATEST}, e AS (SELECT unnest(['dnabert2','nt_v2','gena_lm','hyena_dna']) AS encoder), v AS (SELECT unnest(['base','meanmean','specialmean','meanD','meanG','maxmean','clsmean']) AS pooling), w AS (SELECT CASE WHEN pooling = 'base' THEN encoder ELSE encoder || '_' || pooling END AS feature_source FROM e, v), r AS (SELECT {_FEATURE.format(chr(107))} AS s FROM (SELECT regexp_replace(key, '^data/', '') AS k FROM lr)) SELECT 'family5' AS artifact, feature_source FROM w WHERE feature_source NOT IN (SELECT source FROM lc WHERE task = 'family5' AND NOT shuffled) UNION ALL SELECT 'regression', feature_source FROM w WHERE feature_source NOT IN (SELECT s FROM r WHERE s IS NOT NULL)")
def _(spark, d):
    return reports.missing_cells(_classification(spark, d), _regression(spark, d), names.feature_sources(spark))


QUERIES["j10_missing_cells"], SQL["j10_missing_cells"] = QUERIES["r9_missing_cells"], SQL["r9_missing_cells"]


@query("r10_full_matrix", f"WITH {_LATEST} SELECT source, max(test_macro_f1) FILTER (task = 'family5') AS family5, max(test_macro_f1) FILTER (task = 'tf_vs_gpcr') AS tf_vs_gpcr, max(test_macro_f1) FILTER (task = 'tf_vs_kinase') AS tf_vs_kinase FROM lc WHERE NOT shuffled GROUP BY source")
def _(spark, d):
    return reports.full_matrix(_classification(spark, d))


@query("r12_kappa_summary", f"WITH {_LATEST} SELECT task, source, test_kappa AS kappa FROM lc WHERE NOT shuffled AND test_kappa IS NOT NULL")
def _(spark, d):
    return _classification(spark, d).where("not shuffled and test_kappa is not null").select("task", "source", F.col("test_kappa").alias("kappa"))


@query("r14_retrieval_demo", _KNN + " SELECT k.query, left(d.text, 40) AS about, count(*) FILTER (ql = nl) AS agree FROM k JOIN documents d ON d.doc_id = k.query WHERE rank <= 5 GROUP BY ALL")
def _(spark, d):
    votes = retrieval.vote_agreement(_knn(spark, d), _t(spark, d, "embeddings"))
    about = _t(spark, d, "documents").select(F.col("doc_id").alias("query"), F.left("text", F.lit(40)).alias("about"))
    return votes.join(about, "query").select("query", "about", "agree")
