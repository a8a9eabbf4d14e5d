"""The command line, from raw files to report tables."""

import numpy as np
import pytest

from seqlattice.__main__ import main


def test_from_files_to_reports(spark, tmp_path, capsys):
    d = str(tmp_path)
    run = lambda *a: main(list(map(str, a)), spark)
    r = np.random.default_rng(0)
    groups = ["Protein kinase", "ion channel", "zinc finger"]
    rows = [(f"G{k}", f"E{k}", groups[k % 3]) for k in range(90)]
    (tmp_path / "n.txt").write_text("symbol\tensembl_gene_id\tgene_group\tlocus_group\n" + "".join(f"{s}\t{e}\t{g}\tprotein-coding gene\n" for s, e, g in rows))
    spark.createDataFrame([(s, r.normal(size=3).tolist()) for s, _, _ in rows], "symbol string, y array<double>").write.parquet(f"{d}/emb")
    run("curate", f"{d}/n.txt", f"{d}/emb", "--families", "kinase", "ion", "--out", f"{d}/genes")
    genes = spark.read.parquet(f"{d}/genes")
    assert genes.groupBy("family").count().where("count = 30").count() == 2
    with pytest.raises(ValueError, match="unknown families"):
        run("curate", f"{d}/n.txt", f"{d}/emb", "--families", "none", "--out", f"{d}/x")
    (tmp_path / "fa").mkdir()
    for k, (s, _, _) in enumerate(rows):
        (tmp_path / f"fa/{s}.fasta").write_text(f">{s}\n" + "".join(r.choice(list("ACGT" if k % 3 else "AC"), 300)) + "\n")
    run("fasta", f"{d}/fa", "--out", f"{d}/seqs")
    run("kmers", f"{d}/seqs", "--k", 2, "--out", f"{d}/kmers")
    run("lengths", f"{d}/seqs", "--out", f"{d}/lengths")
    run("windows", f"{d}/seqs", "--out", f"{d}/windows")
    assert spark.read.parquet(f"{d}/kmers").count() == spark.read.parquet(f"{d}/windows").count() == 90
    x = spark.read.parquet(f"{d}/kmers").withColumnRenamed("id", "symbol")
    genes.join(x, "symbol").write.parquet(f"{d}/features")
    run("split", f"{d}/features", "--key", "symbol", "--out", f"{d}/data")
    run("binary", f"{d}/features", "--key", "symbol", "--positive", "kinase", "--negative", "ion", "--out", f"{d}/bin")
    for more in ([], ["--shuffled"]):
        run("ridge", f"{d}/data", "--key", "symbol", "--log", f"{d}/log", *more)
        run("logistic", f"{d}/bin", "--key", "symbol", "--log", f"{d}/log", *more)
    run("report", f"{d}/log", "--out", f"{d}/report")
    text = "\n".join(row.value for row in spark.read.text(f"{d}/report/main_family5/markdown").collect())
    assert "kmer" in text and "anti_baseline" in text
    with pytest.raises(Exception, match="(?i)exist"):
        run("report", f"{d}/log", "--out", f"{d}/report")
    spark.createDataFrame([(k, str(k % 2), str(k % 3 % 2)) for k in range(60)], "id int, true string, pred string").write.parquet(f"{d}/preds")
    run("bootstrap", f"{d}/preds", "--replicates", 20)
    run("confusion", f"{d}/preds", "--out", f"{d}/conf")
    run("inspect", f"{d}/data", "--vector", "x")
    assert "macro_f1" in capsys.readouterr().out and spark.read.parquet(f"{d}/conf").count() == 4
