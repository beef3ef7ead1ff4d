"""Plan checks: no Python in the hot path, pushdown, top-k shapes."""

import pytest

import tillkit.plans.sql as E_sql
from tillkit.plans.catalog import PLANS
from tillkit.operators import listing, reports
from tillkit.plans.catalog import priced
from tillkit.sources import binding as B

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
             "PythonUDF"]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E_sql.PLAN_NAMES))
def test_registered_plan_is_jvm_only(spark, name):
    plan = physical(PLANS[name](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"


def test_tenant_filter_reaches_scan_and_prunes_columns(spark):
    plan = physical(listing.list_customers(B.customers(spark, SF), tenant_id=3))
    assert "EqualTo(c_nationkey,3)" in plan            # tenant filter (F1)
    assert "GreaterThanOrEqual(c_acctb" in plan          # live-row filter (F2)
    summary = physical(reports.sales_summary(priced(spark, SF)))
    assert "o_totalprice" not in summary                 # unused columns never read
    assert "l_shipdate" not in summary and "l_returnflag" not in summary


def test_date_range_reaches_orders_scan(spark):
    plan = physical(reports.sales_summary(priced(spark, SF), start="1996-01-01", end="1996-12-31"))
    scans = [x for x in plan.split("\n") if "FileScan parquet" in x and "orders.parquet" in x]
    assert scans and all(">= 1996-01-01 00:00:00" in x and "IsNotNull(o_orderdate)" in x
                         for x in scans)


def test_date_range_prunes_lines_with_runtime_filter(spark):
    # At scale (line scan above the 10 GB default) Spark injects a bloom filter
    # built from the date-filtered orders into the lineitem scan.
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = reports.sales_summary(priced(spark, SF, start="1996-01-01", end="1996-12-31"))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        lines_filter = [x for x in plan.split("\n") if "might_contain" in x and "l_orderkey" in x]
        assert lines_filter
    finally:
        spark.conf.unset("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_topk_shapes(spark):
    inv, lines, prods = priced(spark, SF), B.invoice_lines(spark, SF), B.products(spark, SF)
    one = physical(reports.top_products(inv, lines, prods, tenant_id=1))
    assert "TakeOrderedAndProject" in one
    allt = physical(reports.top_products(inv, lines, prods))
    assert "WindowGroupLimit" in allt


def test_pricing_aggregates_partially_before_shuffle(spark):
    plan = physical(priced(spark, SF))
    assert "partial_sum" in plan and "partial_count" in plan


def test_bucketed_invoices_price_without_shuffle(spark, scratch):
    import os

    from tillkit.operators import pricing
    from tillkit.sources.tables import write_bucketed

    hdr = B.invoice_headers(spark, SF)
    lines = B.invoice_lines(spark, SF)
    write_bucketed(hdr, "bkt_headers", "request_id", 8, os.path.join(scratch, "h"))
    write_bucketed(lines, "bkt_lines", "invoice_id", 8, os.path.join(scratch, "l"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the big-table path
        priced_b = pricing.price_invoice_lines(spark.table("bkt_headers"), spark.table("bkt_lines"))
        plan = physical(priced_b)
        assert "SortMergeJoin" in plan
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
        want = pricing.price_invoice_lines(hdr, lines)
        assert priced_b.exceptAll(want).count() == 0 and want.exceptAll(priced_b).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bkt_headers")
        spark.sql("DROP TABLE IF EXISTS bkt_lines")


@pytest.mark.parametrize("name", sorted(n for n in E_sql.PLAN_NAMES if not n.startswith("T")))
def test_lineitem_scanned_at_most_once(spark, name):
    plan = physical(PLANS[name](spark, SF))
    assert plan.count("lineitem.parquet") <= 1
