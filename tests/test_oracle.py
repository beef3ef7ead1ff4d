"""Every registered plan against its DuckDB SQL at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck
from tillkit.plans.catalog import PLANS
from tillkit.plans.sql import SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["tenant_id", "sale_date", "total_revenue", "total_invoices"]


def test_every_plan_has_sql():
    assert set(SQL) == set(PLANS)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan_matches_oracle(spark, con, name):
    r = compare(spark, con, name, PLANS[name], SQL.get(name), SF)
    assert r["ok"], r


_TYPES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "StringType()": "VARCHAR",
          "BooleanType()": "BOOLEAN", "DateType()": "DATE", "TimestampNTZType()": "TIMESTAMP",
          "DoubleType()": "DOUBLE"}


def _spark_type(t) -> str:
    return _TYPES.get(repr(t)) or repr(t).replace("DecimalType", "DECIMAL").replace(" ", "")


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_types_match_oracle(spark, con, name):
    df = PLANS[name](spark, "/root/testdata/sf0.001")
    got = {f.name: _spark_type(f.dataType) for f in df.schema.fields}
    rel = con.sql(SQL[name])
    want = {c: str(t).replace(" ", "") for c, t in zip(rel.columns, rel.types)}
    assert got == want


def test_bench_headline_plans_are_registered():
    import bench

    assert set(bench.HEADLINE) <= set(PLANS)
