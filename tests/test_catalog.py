"""Every registered query against its SQL, and those without SQL for their shape."""

import pytest

from conftest import FOLDER
from seqlattice import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_base_indices_of_whole_sequences(spark):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    letters = dict(zip("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC", strict=True))
    want = {r.doc_id: sum("ACGT".find(letters.get(c, c).upper()) % 5 for c in r.text.lower()) for r in texts}
    got = {r.doc_id: r.s for r in QUERIES["q6_base_indices"](spark, FOLDER).collect()}
    assert got == want and max(len(r.text) for r in texts) > 200


def test_registered_sweeps_and_bootstraps_are_whole(spark, monkeypatch):
    import inspect

    from seqlattice.operators import models

    seen = {}
    for name in ("logistic_protocol", "mlp_protocol"):
        monkeypatch.setattr(models, name, lambda *a, name=name, **k: seen.__setitem__(name, (a[1:], k)))
        QUERIES[f"{'m3' if name[0] == 'l' else 'm6'}_{name}"](spark, FOLDER)
    assert seen == {"logistic_protocol": ((), {}), "mlp_protocol": ((models.MLP_CONFIGS,), {})}
    assert len(models.CS) == 6 and len({(c["hidden"], c["decay"]) for c in models.MLP_CONFIGS}) == 9
    for f, name in ((models.bootstrap_classification, "m9_bootstrap_classification"), (models.bootstrap_regression, "m10_bootstrap_regression")):
        assert inspect.signature(f).parameters["replicates"].default == 1000 and "range(1000) t(r)" in SQL[name]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
