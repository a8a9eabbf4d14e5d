"""Queries op1 .. op10 over whole tables with production parameters, and their SQL where SQL can express them.

Each query derives the columns of its contract from the operator's own results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.llm import decontam, embedding_dedup, langid, license_scan, line_dedup, mixing, pii, quality, quotes, simhash

#: Pseudonyms are linked under one key; a deployment passes its own secret to pii.pseudonymise.
PII_KEY = "seqlattice"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 of low quality, 2 neither. Kept: grade 2, more likely than not."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    graded = labels.select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1).alias("grade"))
    return quality.score_quality(docs, quality.fit_quality(docs, graded, levels=3))


def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents")).drop("copies")


def line_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    languages = langid.fit_languages(docs.where(~held))
    return langid.identify(docs, languages).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_found")


def quoted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote linking over the whole table with quotes added, as the table itself has few."""
    return quotes.link_quotes(spark.sql(_QUOTED, conversations=_table(spark, sf_dir, "conversations")))


def quote_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, sf_dir, "conversations"))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=2)


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_query,
        "op2_quality_ordinal": quality_query,
        "op3_embedding_dedup": embedding_query,
        "op4_source_mixing": mixing_query,
        "op5_line_dedup": line_query,
        "op6_language_id": language_query,
        "op7_pii_pseudonyms": pii_query,
        "op8_quote_linking": quote_query,
        "op9_simhash_dedup": simhash_query,
        "op10_decontamination": decontamination_query,
        "quotes_added_to_conversations": quoted_query,
    }


_UPPER, _LOWER = license_scan.UPPER, license_scan.LOWER


def _license_sql() -> str:
    """Every window against every template, every word against every phrase."""
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in license_scan.PHRASES.items())
    listed = lambda ws: f"[{', '.join(repr(w) for w in ws)}]::VARCHAR[]"
    templates = ", ".join(f"({listed(sorted(set(t.split())))}, {listed(sorted({w for w in t.split() if w.isdigit()}))}, {len(t.split())}, '{label}')" for t, label in license_scan.TEMPLATES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH phrase(p, label) AS (VALUES {phrases}), template(t, numbers, n, label) AS (VALUES {templates}),
d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS x FROM documents),
w AS (SELECT doc_id, regexp_extract_all(x, '{word}') AS w FROM d),
place AS (SELECT doc_id, label, unnest(list_filter(range(len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS k
       FROM w, phrase WHERE len(w) >= len(p) AND list_has_all(w, p)),
base AS (SELECT doc_id, count(*) AS n, min(k) AS lo, max(k) AS hi, list(DISTINCT label) AS labels FROM place GROUP BY doc_id),
block AS (SELECT doc_id, label, t, numbers, unnest(list_transform(range(0, len(w), n), lambda k: list_distinct(w[k + 1 : k + 2 * n]))) AS b
          FROM w, template WHERE len(list_intersect(w, t)) >= ceil({license_scan.THRESHOLD} * len(t) - 1e-9)),
met AS (SELECT doc_id, label, len(list_intersect(b, t)) / len(t) AS c FROM block
        WHERE len(list_intersect(b, t)) >= ceil({license_scan.THRESHOLD} * len(t) - 1e-9) AND list_has_all(b, numbers)),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM met GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


_EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a, ok b
         WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT DISTINCT a, a AS b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
  vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a"""

_MIXING_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
w AS (SELECT *, ((k - 1) % 3 + 1)::DOUBLE AS w FROM k),
r AS (SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT max(level) FILTER (level * w <= 3.0::DOUBLE * source_size) AS level FROM r),
t AS (SELECT source, source_size, least(coalesce(l.level * w, 3.0::DOUBLE * source_size), 3.0::DOUBLE * source_size)::DOUBLE AS target FROM w, l),
m AS (SELECT *, md5('7|' || coalesce(doc_id::VARCHAR, 'null')) AS mark FROM d),
g AS (SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 2, 2) AS class, ('0x' || substr(mark, 1, 8))::BIGINT % {mixing.SALTS} AS salt FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, mark, doc_id) AS place FROM g),
e AS (SELECT p.*, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0) * {mixing.UNIT}), 0)::BIGINT AS each,
      ('0x' || substr(md5('7|offset|' || coalesce(p.source, 'null')), 1, 8))::BIGINT % {mixing.UNIT} AS offs
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * ((place * each + offs) // {mixing.UNIT} - ((place - 1) * each + offs) // {mixing.UNIT})::BIGINT AS taken FROM e"""

_LINE_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.n, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""

#: Conversations with quotes from the table itself: of the turn before, of another conversation, nested, short, and one hot passage.
_QUOTED = r"""SELECT a.conv_id, a.turn, a.role,
  CASE WHEN a.turn % 3 = 1 AND b.text IS NOT NULL THEN '> ' || split_part(b.text, chr(10), 1) || chr(10) || CASE WHEN a.conv_id % 2 = 0 THEN '>> ' || split_part(c.text, chr(10), 1) || chr(10) ELSE '' END || 're: ' || a.text
       WHEN a.turn % 3 = 2 AND a.conv_id % 4 = 0 AND c.text IS NOT NULL THEN a.text || chr(10) || ' > ' || upper(split_part(c.text, chr(10), 1)) || chr(10) || '> ok'
       WHEN a.turn % 3 = 2 THEN '> this passage is quoted by very many' || chr(10) || '>' || chr(10) || a.text
       WHEN a.turn = 0 AND a.conv_id % 10 = 3 THEN 'this passage is quoted by very many' || chr(10) || 'ok' || chr(10) || a.text ELSE a.text END AS text
FROM {conversations} a LEFT JOIN {conversations} b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 LEFT JOIN {conversations} c ON a.conv_id = c.conv_id + 1 AND c.turn = 0"""

_QUOTE_SQL = rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, row_number() OVER () AS r FROM {{conversations}}),
l AS (SELECT r, conv_id AS c, turn AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM m),
v AS (SELECT *, length(regexp_replace(regexp_extract(line, '{quotes.MARKS}'), '[^>]', '', 'g')) AS level,
      translate(trim(regexp_replace(regexp_replace(line, '{quotes.MARKS}', ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '{_UPPER}', '{_LOWER}') AS p FROM l),
own AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (level = 0), '') AS text, count(*) FILTER (level > 0) AS n_quoted, max(level) AS max_level FROM v GROUP BY r),
plain AS (SELECT * FROM v WHERE p <> '' AND c IS NOT NULL AND t IS NOT NULL),
q AS (SELECT c, t, p, min(level) AS level FROM plain WHERE level > 0 GROUP BY ALL),
o AS (SELECT c, p, min(t) AS ot FROM plain WHERE level = 0 GROUP BY ALL),
g AS (SELECT p, c AS gc, ot AS gt FROM o WHERE length(p) >= {quotes.LEAST_CHARS} QUALIFY row_number() OVER (PARTITION BY p ORDER BY c, ot) = 1),
k AS (SELECT q.c, q.t, q.level, CASE WHEN o.ot < q.t THEN q.c WHEN g.gc <> q.c THEN g.gc END AS rc, CASE WHEN o.ot < q.t THEN o.ot WHEN g.gc <> q.c THEN g.gt END AS rt
      FROM q LEFT JOIN o ON q.c = o.c AND q.p = o.p LEFT JOIN g ON q.p = g.p),
votes AS (SELECT c, t, rc, rt, min(level) AS level, count(*) AS n FROM k WHERE rc IS NOT NULL GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY c, t) AS n_linked FROM votes QUALIFY row_number() OVER (PARTITION BY c, t ORDER BY level, n DESC, rc <> c, rt DESC, rc) = 1),
up AS (SELECT c, t, rc AS root_c, rt AS root_t, 1 AS depth FROM b UNION ALL SELECT up.c, up.t, b.rc, b.rt, depth + 1 FROM up JOIN b ON up.root_c = b.c AND up.root_t = b.t WHERE depth <= (SELECT count(*) FROM b)),
root AS (SELECT up.* FROM up LEFT JOIN b ON up.root_c = b.c AND up.root_t = b.t WHERE b.c IS NULL)
SELECT m.conv_id, m.turn, m.role, own.text, coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(max_level, 0)::BIGINT AS max_level, coalesce(n_linked, 0)::BIGINT AS n_linked,
  b.rc AS reply_conv, b.rt AS reply_turn, CASE WHEN b.c IS NULL THEN m.conv_id ELSE root.root_c END AS thread_conv,
  CASE WHEN b.c IS NULL THEN m.turn ELSE root.root_t END AS thread_turn, CASE WHEN b.c IS NULL THEN 0 ELSE root.depth END::BIGINT AS depth
FROM m LEFT JOIN own USING (r) LEFT JOIN b ON m.conv_id = b.c AND m.turn = b.t LEFT JOIN root ON m.conv_id = root.c AND m.turn = root.t"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _license_sql(), "op3_embedding_dedup": _EMBEDDING_SQL, "op4_source_mixing": _MIXING_SQL, "op5_line_dedup": _LINE_SQL, "op8_quote_linking": _QUOTE_SQL.format(conversations="conversations"), "quotes_added_to_conversations": _QUOTE_SQL.format(conversations=f"({_QUOTED.format(conversations='conversations')})")}
