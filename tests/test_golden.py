"""Worked examples of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.functions import names, sequence, vector
from seqlattice.operators import curation, metrics, models, ranking
from seqlattice.plans import reports
from seqlattice.sources import io
from seqlattice.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_kmer(spark):
    df = spark.createDataFrame([("a", "AAAAC"), ("b", "ACG"), ("c", "nnNNn"), ("d", None), ("e", "acgtN")], "id string, seq string")
    x = {r.id: r.x for r in sequence.kmer_frequencies(df, "id", "seq").collect()}
    assert (x["a"][0], x["a"][1], sum(x["a"]), len(x["a"])) == (0.5, 0.5, 1.0, 256)
    assert all(sum(x[k]) == 0 for k in "bcd") and x["e"][0 * 64 + 1 * 16 + 2 * 4 + 3] == 1
    counts = {(r.id, r.kmer): r.n for r in sequence.kmer_counts(df, "id", "seq").collect()}
    assert counts == {("a", "AAAA"): 1, ("a", "AAAC"): 1, ("e", "ACGT"): 1}


@pytest.mark.parametrize(("n", "starts"), [(0, [0]), (510, [0]), (511, [0, 446]), (1000, [0, 446, 892])])
def test_chunk_starts(spark, n, starts):
    assert one(spark, sequence.chunk_starts(F.lit(n), 510, 64)) == starts


@pytest.mark.parametrize(("lo", "hi", "strand", "length", "want"), [(1000, 2000, 1, 11, (995, 1005)), (1000, 2000, -1, 11, (1995, 2005)), (3, 50, 1, 10, (1, 10))])
def test_tss_window(spark, lo, hi, strand, length, want):
    low, high = sequence.tss_window(F.lit(lo), F.lit(hi), F.lit(strand), length)
    assert tuple(spark.range(1).select(low, high).first()) == want
    with pytest.raises(ValueError, match="positive"):
        sequence.tss_window(F.lit(1), F.lit(2), F.lit(1), 0)


def test_text_functions(spark):
    assert one(spark, sequence.fasta_sequence(F.lit(">h\nacg\n\nTTn\n>h2\nAA"))) == "ACGTTNAA"
    assert one(spark, sequence.centre_fit(F.lit("ACGTA"), 3)) == "CGT" and one(spark, sequence.centre_fit(F.lit("ACG"), 6)) == "NACGNN"
    assert one(spark, sequence.base_indices(F.lit("aCGTn"))) == [0, 1, 2, 3, 4]
    assert one(spark, sequence.centre_slice(F.array(*map(F.lit, range(7))), 3)) == [2, 3, 4]
    assert one(spark, sequence.excerpt(F.lit("  a|b c "), 3)) == "a/b..." and one(spark, sequence.signed4(F.lit(None).cast("double"))) == "-"
    assert one(spark, sequence.markdown_cell(F.lit(" **`kmer`** (base) "))) == "kmer"


def test_names(spark):
    df = spark.createDataFrame([("kmer",), ("dnabert2",), ("nt_v2",), ("gena_lm_meanD",)], "s string").select("s", names.dataset_of(F.col("s")).alias("d"))
    assert {r.s: r.d for r in df.collect()} == {"kmer": None, "dnabert2": "dataset.parquet", "nt_v2": "dataset_nt_v2.parquet", "gena_lm_meanD": "dataset_gena_lm_meanD.parquet"}
    assert all(r.b == r.s for r in df.where("d is not null").select("s", names.feature_of(F.col("d")).alias("b")).collect())
    with pytest.raises(ValueError, match="unknown encoder"):
        names.known_encoder("other")


def test_pooling(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0])], "id string, chunk_no int, vec array<float>")
    p = vector.pooled(df, "id")
    row = p.select(p["mean_vec"], vector.mean_d(p).alias("d"), vector.mean_g(p).alias("g")).first()
    assert row.mean_vec == [2, 3] and row.d == [1, 2, 3, 4, 2, 3] and row.g == [1, 2, 3, 4, 2, 3, 3, 4]
    special = spark.createDataFrame([("a", 0, [7.0, 8.0]), ("a", 1, [9.0, 10.0])], "id string, chunk_no int, vec array<float>")
    assert vector.pooled(special, "id").first().mean_vec == [8, 9]
    assert one(spark, vector.available_poolings(F.array(F.lit("mean"), F.lit("max")))) == ["meanmean", "maxmean", "meanD", "meanG"]
    assert vector.pooled_width("meanG", 768) == 3072
    with pytest.raises(ValueError, match="unknown pooling"):
        vector.pooled_width("other", 1)


def test_token_reductions_without_special_tokens(spark):
    df = spark.createDataFrame([(1, 0, [1.0], False), (1, 1, [3.0], False)], "c int, pos int, vec array<double>, special boolean")
    row = vector.token_reductions(df, ["c"]).first()
    assert (row["mean"], row["special_mean"], row["max"], row["cls"]) == ([2.0], [2.0], [3.0], None)


# A published confusion matrix (gpcr, immune, ion, kinase, tf) and its scores.
MATRIX = [[84, 1, 3, 1, 0], [1, 16, 1, 3, 2], [2, 0, 18, 4, 6], [0, 0, 0, 67, 17], [3, 0, 1, 10, 247]]
SCORES = {"accuracy": 0.887064, "kappa": 0.821369, "macro_f1": 0.827504, "balanced_accuracy": 0.796690}


def test_summary_of_a_matrix(spark):
    rows = [(f"c{i}", f"c{j}", n) for i, line in enumerate(MATRIX) for j, n in enumerate(line)]
    table = spark.createDataFrame(rows, "true string, pred string, n int")
    got = metrics.summary(table, "true", "pred", weight="n").first()
    assert got.n == 487 and {k: round(got[k], 6) for k in SCORES} == SCORES


def test_kappa_undefined(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a")], "t string, p string")
    assert metrics.summary(df, "t", "p").first().kappa is None
    assert metrics.summary(df.limit(0), "t", "p").first().kappa is None


RUNS = "run_id int, timestamp string, model string, encoder string, feature_source string, task string, shuffled_labels boolean, dataset string, test_macro_f1 double, test_kappa double, test_accuracy double, C double, test_r2_macro double, test_mean_cosine double, test_median_cosine double, alpha double"


def runs(spark, rows):
    cols = [c.split()[0] for c in RUNS.split(", ")]
    return spark.createDataFrame([tuple(dict({"run_id": k, "model": "logistic_probe", "task": "family5", "timestamp": f"2025-01-0{k % 9 + 1}"}, **r).get(c) for c in cols) for k, r in enumerate(rows)], RUNS)


def test_latest_keeps_shuffled_apart(spark):
    r = runs(spark, [dict(feature_source="a", test_macro_f1=0.1), dict(feature_source="a", test_macro_f1=0.8), dict(feature_source="a", test_macro_f1=0.2, shuffled_labels=True)])
    assert {x.shuffled: x.test_macro_f1 for x in ranking.latest_classification(r).collect()} == {False: 0.8, True: 0.2}


def test_latest_tie_takes_the_later_entry(spark):
    r = runs(spark, [dict(feature_source="a", test_macro_f1=0.1, timestamp="t"), dict(feature_source="a", test_macro_f1=0.0, timestamp="t")])
    assert ranking.latest_classification(r).first().test_macro_f1 == 0.0


def test_best_pooling_and_deltas(spark):
    cells = [("kmer", 0.67, 0.70), ("nt_v2_meanG", 0.80, 0.80), ("nt_v2_meanD", 0.83, 0.82), ("hyena_dna_meanG", 0.71, 0.71)]
    c = ranking.latest_classification(runs(spark, [dict(feature_source=s, test_macro_f1=f, test_kappa=k) for s, f, k in cells]))
    got = {x.encoder: x for x in reports.best_family5(c).collect()}
    assert set(got) == {"nt_v2", "hyena_dna"} and got["nt_v2"].pooling == "meanD"
    assert got["nt_v2"].delta_f1_vs_4mer == pytest.approx(0.16) and got["nt_v2"].delta_kappa_vs_4mer == pytest.approx(0.12)


def test_regression_control(spark):
    rows = [dict(model="kmer_baseline_4", test_r2_macro=0.17), dict(model="anti_baseline_shuffled_y", dataset="a", test_r2_macro=-0.02), dict(model="anti_baseline_shuffled_y", dataset="b", test_r2_macro=-0.01), dict(model="linear_probe", dataset="dataset_nt_v2.parquet", test_r2_macro=0.19)]
    full = reports.regression_full(ranking.latest_regression(runs(spark, rows))).where("encoder = 'shuffled_y'").collect()
    assert len(full) == 1 and full[0].pooling == "-" and full[0].delta_vs_4mer == pytest.approx(-0.18)


def test_missing_cells(spark):
    c = ranking.latest_classification(runs(spark, [dict(feature_source="nt_v2_meanD", test_macro_f1=0.5)]))
    r = ranking.latest_regression(runs(spark, [dict(model="linear_probe", dataset="dataset_nt_v2_meanD.parquet")]))
    wanted = spark.createDataFrame([("nt_v2_meanD",), ("gena_lm_meanD",), ("kmer",)], "feature_source string")
    assert {tuple(x) for x in reports.missing_cells(c, r, wanted).collect()} == {("family5", "gena_lm_meanD"), ("regression", "gena_lm_meanD")}


def test_context_reads_prefixed_datasets(spark):
    c = ranking.latest_classification(runs(spark, [dict(feature_source="enformer_trunk_global", test_macro_f1=0.545)]))
    r = ranking.latest_regression(runs(spark, [dict(model="linear_probe", dataset="data/dataset_enformer_trunk_center.parquet", test_r2_macro=0.1425)]))
    row = next(x for x in reports.context_ablation(c, r).collect() if x.label == "Enformer trunk")
    assert (row.family5_macro_f1, row.ridge_r2_macro) == (0.545, 0.1425)


def test_rules(spark):
    df = spark.createDataFrame([("Zinc fingers|Protein kinase",), ("kinase inhibitor",), (None,), ("ion channel",)], "g string")
    assert [r.f for r in df.select(curation.assign(F.col("g"), curation.FAMILY_RULES).alias("f")).collect()] == ["kinase", None, None, "ion"]
    assert [r[0] for r in curation.rules_named(["tf"])] == ["tf"]
    with pytest.raises(ValueError, match="unknown families"):
        curation.rules_named(["nope"])


def test_cap_before_claim(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "b")], "id int, t string")
    got = curation.assign_capped(df, "id", "t", "id", (("a", "", ("a",), ()), ("b", "", ("b",), ())), 1).collect()
    assert {(r.id, r.family) for r in got} == {(1, "a"), (2, "b")}


def test_ordered_lookup_fails_on_missing(spark):
    data = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    want = spark.createDataFrame([(2, 0), (1, 1)], "id int, pos int")
    assert [r.v for r in curation.ordered_lookup(want, data, "id").collect()] == ["y", "x"]
    with pytest.raises(Exception, match="missing id"):
        curation.ordered_lookup(spark.createDataFrame([(9, 0)], "id int, pos int"), data, "id").collect()


def test_split_is_exact(spark):
    df = spark.range(1000).withColumn("f", F.when(F.col("id") < 600, "a").otherwise("b"))
    s = curation.stratified_split(df, "id", "f")
    assert {(r.f, r.split): r["count"] for r in s.groupBy("f", "split").count().collect()} == {("a", "train"): 420, ("a", "val"): 90, ("a", "test"): 90, ("b", "train"): 280, ("b", "val"): 60, ("b", "test"): 60}
    assert curation.split_violations(s, df, "id").count() == 0


def test_ridge_is_the_closed_form(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3))
    y = x @ r.normal(size=(3, 2)) + 1 + 0.1 * r.normal(size=(200, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>").repartition(5)
    w, b = models.gram(df).ridge(2.0)
    xc, yc = x - x.mean(0), y - y.mean(0)
    assert np.allclose(w, np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc)) and np.allclose(b, y.mean(0) - x.mean(0) @ w)


def test_logistic_gradient_vanishes(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 2))
    y = (x @ [1.0, -2.0] + r.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, label int")
    m = models.logistic(df, 1.0)
    w, b = m.coefficients.toArray(), m.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs((p - y) @ x + w).max() < 1e-2 and abs((p - y).sum()) < 1e-2


def test_io(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "g.txt").write_text("symbol\tensembl_gene_id\tgene_group\tlocus_group\textra\nA\tE1\t\tprotein-coding gene\tx\nB\tE2\tg\tRNA\tx\n")
    assert [tuple(r) for r in io.nomenclature(spark, f"{d}/g.txt").collect()] == [("A", "E1", "", io.PROTEIN)]
    (tmp_path / "m.json").write_text('{"A": [1.5, 2], "B": [3, 4]}')
    assert {r.symbol: list(r.y) for r in io.json_map(spark, f"{d}/m.json", "y", "array<float>").collect()} == {"A": [1.5, 2], "B": [3, 4]}
    (tmp_path / "fa").mkdir()
    (tmp_path / "fa/ENSG1.fasta").write_text(">x\nac\ngt\n")
    assert [tuple(r) for r in io.fasta(spark, f"{d}/fa").collect()] == [("ENSG1", "ACGT")]
    (tmp_path / "s.json").write_text('{"train": ["a"], "val": ["b"], "test": ["c", "d"], "seed": 42, "stratify": "family"}')
    assert {(r.id, r.split) for r in io.split_manifest(spark, f"{d}/s.json").collect()} == {("a", "train"), ("b", "val"), ("c", "test"), ("d", "test")}
    (tmp_path / "c.json").write_text('{"classes": ["a", "b"], "matrix": [[3, 1], [0, 2]]}')
    conf = io.confusion_json(spark, f"{d}/c.json")
    assert {(r.true, r.pred): r.n for r in conf.collect()} == {("a", "a"): 3, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 2}
    io.write_confusion(conf, f"{d}/c2")
    assert io.confusion_json(spark, f"{d}/c2").drop("file").exceptAll(conf.drop("file")).count() == 0
    io.save_probe(spark, f"{d}/p", np.eye(2), np.array([1.0, 2.0]), alpha=0.5)
    w, b = io.load_probe(spark, f"{d}/p")
    assert np.array_equal(w, np.eye(2)) and b.tolist() == [1, 2]
    io.append_runs(spark.createDataFrame([("r1", "logistic_probe")], "run_id string, model string"), f"{d}/log")
    io.append_runs(spark.createDataFrame([("r2", 0.5)], "run_id string, test_kappa double"), f"{d}/log")
    assert {(r.run_id, r.model, r.test_kappa) for r in io.run_log(spark, f"{d}/log").collect()} == {("r1", "logistic_probe", None), ("r2", None, 0.5)}
    (tmp_path / "k.md").write_text("# Kappa\n## Five classes\n| source | kappa |\n| --- | --- |\n| `kmer` | **0.7024** |\n| shuffled-label (control) | +0.0482 |\n## Other\n| kmer | 0.1 |\n")
    assert {(r.task, r.label): r.value for r in io.markdown_metrics(spark, f"{d}/k.md", {"Five classes": "family5"}).collect()} == {("family5", "kmer"): 0.7024, ("family5", "shuffled-label"): 0.0482}
    small = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, v double")
    io.report(small, f"{d}/rep", "Title")
    text = "\n".join(r.value for r in spark.read.text(f"{d}/rep/markdown").collect())
    assert "# Title" in text and "| name | v |" in text and "0.5000" in text
    with pytest.raises(Exception, match="(?i)exist"):
        io.report(small, f"{d}/rep", "Title")
    io.report(small, f"{d}/rep", "Title", overwrite=True)
    io.manifest(spark, f"{d}/man", ["a"], ["b"])
    assert spark.read.json(f"{d}/man").first().inputs == ["a"]


def test_retries():
    calls, pauses = [], []

    def fetch(key):
        calls.append(key)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert io.with_retries(fetch, 3, pauses.append)("k") == "ok" and pauses == [1.0, 2.0]


def test_refresh_works_on_pending_only(spark, tmp_path):
    inputs = spark.range(5).withColumn("v", F.lit("x"))
    work = lambda df: df.select("id", F.upper("v").alias("v"))
    path = f"{tmp_path}/cache"
    assert incremental.refresh(inputs.where("id < 3"), path, "id", work) == 3
    assert incremental.refresh(inputs, path, "id", work) == 2 and incremental.refresh(inputs, path, "id", work) == 0
    assert spark.read.parquet(path).count() == 5


def test_bundle(spark):
    from conftest import FOLDER
    from seqlattice.plans.proxies import spark_view

    tables = reports.bundle(spark_view(spark, FOLDER, "runs"), names.feature_sources(spark))
    assert {len(t.columns) > 0 for t in tables.values()} == {True} and tables["main_family5"].first().encoder == "kmer"


def test_mlp_is_scored_on_all_rows(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 3))
    split = ["train", "val", "test", "test"]
    rows = [(i, split[i % 4], v.tolist(), [float(v @ [1, 2, 3]) + (i == 398) * 1000]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, split string, x array<double>, y array<double>")
    for bound in (30, 1000):
        # one test row far off shows in the mean over all 200 test rows
        got = models.mlp_protocol(df, [{"hidden": 8, "epochs": 2}], bound).first()
        assert 4900 < got.test_mse < 5200 and got.val_loss < 100


def test_means_of_chunks_need_their_reduction(spark):
    rows = [("a", [1.0, 2.0], [5.0, 0.0], None), ("a", [3.0, 4.0], [1.0, 2.0], [7.0, 7.0])]
    chunks = spark.createDataFrame(rows, "id string, special_mean array<double>, max array<double>, cls array<double>")
    assert vector.mean_of_chunks(chunks, "id", "specialmean").first().x == [2.0, 3.0]
    assert vector.mean_of_chunks(chunks, "id", "maxmean").first().x == [3.0, 1.0]
    with pytest.raises(Exception, match="clsmean needs cls, absent in a chunk of a"):
        vector.mean_of_chunks(chunks, "id", "clsmean").collect()
    with pytest.raises(ValueError, match="meanmean needs mean"):
        vector.mean_of_chunks(chunks, "id", "meanmean")
    with pytest.raises(ValueError, match="unknown pooling"):
        vector.mean_of_chunks(chunks, "id", "median")


def test_places_in_ranges_are_those_of_one_sort(spark):
    from pyspark.sql import Window

    df = spark.range(5000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"), F.when(F.col("id") % 3 != 0, F.col("id") % 5).alias("s"), "id")
    w = Window.partitionBy("s")
    want = df.where("k is not null").withColumn("_p", F.row_number().over(w.orderBy(curation.seeded(F.col("k"), 42), "k"))).withColumn("_c", F.count("*").over(w))
    got = curation.placed(df.where("k is not null"), "k", "s")
    assert sorted(map(str, got.select("id", "_p", "_c").collect())) == sorted(map(str, want.select("id", "_p", "_c").collect()))
    # null keys come first, in some order; every place is taken once
    every = curation.placed(df, "k", "s")
    assert every.count() == 5000 and every.groupBy("s").agg(F.count_distinct("_p").alias("n"), F.max("_p").alias("m"), F.max("_c").alias("c")).where("n <> m or m <> c").count() == 0


def test_report_tables_in_markdown_and_bundle(spark):
    from conftest import FOLDER
    from seqlattice import registry
    from seqlattice.plans.catalog import _classification
    from seqlattice.plans.proxies import spark_view

    q = registry.queries()
    lines = [r.line for r in q["r11_markdown_tables"](spark, FOLDER).where("name = 'family5'").collect()]
    rows = reports.main_family5(_classification(spark, FOLDER)).collect()
    text = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    found = [[c.strip() for c in line.split("|")[1:-1]] for line in lines if line.startswith("| ")][2:]
    assert lines[0] == "# family5" and [r[:3] for r in found] == [[text(r.encoder), text(r.pooling), text(r.feature_source)] for r in rows]
    assert all(abs(float(f[3]) - r.test_macro_f1) < 6e-5 for f, r in zip(found, rows, strict=True) if r.test_macro_f1 is not None)
    tables = reports.bundle(spark_view(spark, FOLDER, "runs"), names.feature_sources(spark))
    got = {(r.kind, r.name) for r in q["r15_report_bundle"](spark, FOLDER).collect()}
    assert {n for k, n in got if k == "output"} == {f"{t}/{f}" for t in tables for f in ("csv", "markdown")}
    assert {n for k, n in got if k == "missing"} == {f"{r.artifact}:{r.feature_source}" for r in tables["missing_cells"].collect()}


def test_places_by_key_without_one_sort(spark):
    import random

    r = random.Random(8)
    for kind, keys in (("long", r.sample(range(-(10**12), 10**12), 3000)), ("string", [f"{chr(r.choice((65, 233, 8364)))}{k}" for k in range(3000)]), ("long", [5]), ("long", [])):
        rows = [(k, r.choice(("a", "b", None)) if r.random() < 0.2 else "hot") for k in keys] + [(None, "hot")] * bool(keys)
        got = {(x.k, x.s): (x["_p"], x["_c"]) for x in curation.in_order(spark.createDataFrame(rows, f"k {kind}, s string"), "k", "s").collect()}
        want = {}
        for s in {s for _, s in rows}:
            own = sorted((k for k, t in rows if t == s and k is not None))
            own = [None] * any(k is None and t == s for k, t in rows) + own
            want |= {(k, s): (n, len(own)) for n, k in enumerate(own, 1)}
        assert got == want


def test_draws_in_blocks_are_those_of_one(spark, monkeypatch):
    df = spark.createDataFrame([(k, "a" if k % 7 else None) for k in range(500)], "k long, s string")
    whole = sorted(map(tuple, models.stratified_draws(df, "k", "s", 3).collect()))
    monkeypatch.setattr(models, "DRAWS", 11)
    assert sorted(map(tuple, models.stratified_draws(df, "k", "s", 3).collect())) == whole
    for rep in range(3):
        assert sum(w for i, k, w in whole if i == rep and k % 7 == 0) == 72 and sum(w for i, _, w in whole if i == rep) == 500


def test_draws_are_not_broadcast(spark):
    df = spark.range(50).select("id", F.array(F.col("id") * 1.0).alias("y"), F.array(F.col("id") % 7 * 1.0).alias("p"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")  # draws are estimated by the few rows that they are made of
    try:
        for out in (models.bootstrap_regression(df, "id", "y", "p"), models.stratified_draws(df, "id", None, 1000)):
            depth, drawn, broadcast = 1_000, 0, 0
            for line in out._jdf.queryExecution().executedPlan().toString().split("\n"):
                at = len(line) - len(line.lstrip(" :+-"))
                depth = at if "HashedRelationBroadcastMode" in line and at < depth else 1_000 if at <= depth else depth
                drawn, broadcast = drawn + ("md5(" in line and "_j#" in line), broadcast + ("_j#" in line and at > depth)
            assert drawn and not broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_draws_are_dealt_to_all_tasks(spark):
    draws, _ = models._drawn(spark.range(50), "id", None, 200, 42)
    assert draws.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("nan", [False, True])
def test_bootstrapped_r2_by_brute_force(spark, monkeypatch, nan):
    import hashlib

    # short, empty, unknown and repeated rows; blocks and lists of few draws
    rows = [(k, [k % 5 * 1.0, None if k % 4 == 0 else k * 0.5, k * 7 % 11 * 1.0][: 3 if k % 6 else 2], [k % 5 + k % 3 * 0.25, None if k % 9 == 0 else k * 0.4, k % 7 * 1.0]) for k in range(60)]
    rows += [(60, None, [1.0]), (61, [], []), (5, [9.0, 8.0, 7.0], [9.0, 8.0, 6.0]), *([(62, [float("nan"), 1.0, 2.0], [1.0, 2.0, 3.0])] if nan else [])]
    for name, value in (("PLACES", 7), ("GATHERED", 50)):
        monkeypatch.setattr(models, name, value)
    keys, scores = sorted(r[0] for r in rows), []
    for rep in range(40):
        at = [int(hashlib.md5(f"42|{rep}||{j}".encode()).hexdigest()[:8], 16) % len(rows) for j in range(len(rows))]
        drawn = [(y, p) for i in at for k, y, p in rows if k == keys[i] and y is not None and p is not None]
        r2 = []
        for d in range(3):
            pairs = [(y[d] if d < len(y) else None, p[d] if d < len(p) else None) for y, p in drawn if d < max(len(y), len(p))]
            t = [a for a, _ in pairs if a is not None]
            r2.append(1 - sum((a - b) ** 2 for a, b in pairs if a is not None and b is not None) / (sum(a * a for a in t) - sum(t) ** 2 / len(pairs)))
        scores.append(np.mean(r2))
    scores = np.sort(scores)  # NaN last, as in Spark
    want = [scores[int(q)] + (q % 1) * (scores[int(q) + 1] - scores[int(q)]) for q in (0.025 * 39, 0.975 * 39)]
    got = models.bootstrap_regression(spark.createDataFrame(rows, "k long, y array<double>, p array<double>"), "k", "y", "p", 40).first()
    assert np.allclose([got.lo, got.hi], want, rtol=1e-9, equal_nan=True) and np.isnan(want[1]) == nan and not np.isnan(want[0])


def test_permuted_labels_keep_rows_and_labels(spark):
    df = spark.createDataFrame([(k, f"y{k % 5}", "s" if k % 3 else "t") for k in range(400)], "k long, y string, s string")
    for within in (None, "s"):
        got = curation.permuted_labels(df, "k", "y", within)
        assert got.columns == df.columns or set(got.columns) == set(df.columns)
        before, after = ({x.k: (x.y, x.s) for x in d.collect()} for d in (df, got))
        assert before.keys() == after.keys() and before != after
        part = (lambda v: v) if within else (lambda v: v[0])
        assert sorted(map(part, before.values())) == sorted(map(part, after.values()))
