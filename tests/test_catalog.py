import pytest
from pyspark.sql import functions as F

from tactus.plans import catalog
from tests.oracle import compare

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, name):
    compare(catalog.QUERIES[name](spark, D), catalog.ORACLES[name], D)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_exact_parity_compares_every_entry(spark, monkeypatch):
    compare_pairs, late = catalog.parity.exact_parity, (F.col("i") == 63) & (F.col("vec_id") % 2 == 0)

    def spoilt(pairs, by, columns):
        counts = pairs.groupBy(by).count().select("count").distinct().collect()
        assert [r["count"] for r in counts] == [64]
        return compare_pairs(pairs.withColumn("b", F.when(late, F.col("a") + 1).otherwise(F.col("b"))), by, columns)

    plain = {r["vec_id"]: r["equal"] for r in catalog.QUERIES["exact_parity"](spark, D).collect()}
    assert {*plain.values()} == {True, False}
    monkeypatch.setattr(catalog.parity, "exact_parity", spoilt)
    found = {r["vec_id"]: r["equal"] for r in catalog.QUERIES["exact_parity"](spark, D).collect()}
    assert found == {v: equal and v % 2 == 1 for v, equal in plain.items()}
