"""Every registered query with an oracle agrees with DuckDB; the others run."""

import compare
import pytest

from tallywright.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, con, name):
    assert compare.differences(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    QUERIES[name](spark, SF).count()


@pytest.mark.parametrize("name", ["recurring_charges", "expense_report"])
def test_days_beyond_the_year_9999(spark, tmp_path, name):
    """Larger tables have larger keys, whose charges fall on days that no printed date can hold."""
    spark.range(30 * 97_200, 30 * 97_340).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert compare.differences(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
