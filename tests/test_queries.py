import importlib
import sys

import pytest

from loomfit.queries import ORACLES, QUERIES

from .oracle import assert_same, connect

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"rank_bases_events"}))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_range_ends_where_its_sql_does(spark, tmp_path):
    """With 6,000 keys the SQL's 1,000 places end before the data do."""
    spark.range(3, 6003).selectExpr("id as p_partkey", "900 + (id * 37 % 1000) / 10.0D as p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["predict_range_part"](spark, str(tmp_path))
    assert got.count() == 1000 and got.agg({"x": "max"}).first()[0] == 4988
    assert_same(got, connect(str(tmp_path)), ORACLES["predict_range_part"])


def test_scalar_functions_of_odd_balances(spark, tmp_path):
    """Large tables hold balances of minus zero; nulls, NaN and infinities compare as in SQL."""
    odd = [-0.0, 0.0, None, float("nan"), float("inf"), float("-inf"), -0.004, 99.995, -100.5, 1e300]
    spark.createDataFrame([*enumerate(odd), (None, 1.0)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    assert_same(QUERIES["scalar_functions_customer"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLES["scalar_functions_customer"])


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["p_partkey", "y_fit", "residual"] and df.count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_llm_folder(monkeypatch):
    import __spark_entry__ as e

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("loomfit.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(name, name=name)

    for m in [m for m in sys.modules if m.startswith(("loomfit.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    again = importlib.reload(e)
    assert set(again.queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(e)
