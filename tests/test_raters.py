"""Every supplier and every nation rates: the panel queries on more than 100 suppliers, against the same SQL."""

import duckdb
import pytest

from scimap.plans import registry

SF, N = "/root/testdata/sf0.001", 250


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raters"))
    rows = [(i, i * 7 % 25) for i in range(N)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_nationkey bigint").coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return folder


@pytest.mark.parametrize("name", ["stat_krippendorff", "stat_kappa_pairs", "delphi_revision"])
def test_all_suppliers_rate(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from read_parquet('{sf}/supplier.parquet/*.parquet')")
    got = con.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    want = sorted(got.fetchall())
    rows = sorted(tuple(r[c] for c in names) for r in registry.QUERIES[name](spark, sf).collect())
    assert len(rows) == len(want) and all(a == pytest.approx(b, abs=2e-8) for a, b in zip(rows, want, strict=True))
    if name == "delphi_revision":
        assert len(rows) == 10 * N


def test_bootstrap_is_of_all_suppliers(spark, sf):
    alpha = {r.cluster: r.alpha for r in registry.QUERIES["stat_krippendorff"](spark, sf).collect()}
    rows = registry.QUERIES["stat_bootstrap_alpha"](spark, sf).collect()
    assert {r.cluster: r.alpha for r in rows} == pytest.approx(alpha, abs=1e-6)
    assert all(r.low <= r.high for r in rows)


def test_all_nations_rate(spark):
    nations = spark.read.parquet(f"{SF}/nation.parquet").count()
    rows = registry.QUERIES["delphi_simulation"](spark, SF).collect()
    assert nations > 8 and rows and {r.n_pairs for r in rows} == {nations * (nations - 1) // 2}
