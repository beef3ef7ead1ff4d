import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillkit.operators import reports
from tillkit.plans.catalog import priced
from tillkit.sources import binding as B

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inv(spark):
    return priced(spark, SF).cache()


def _by_tenant(df, *cols):
    return {r.tenant_id: tuple(r[c] for c in cols) for r in df.collect()}


def test_daily_and_method_sums_equal_summary(inv):
    summary = _by_tenant(reports.sales_summary(inv), "total_revenue", "total_invoices")
    daily = reports.daily_sales(inv).groupBy("tenant_id").agg(
        F.sum("total_revenue").alias("total_revenue"), F.sum("total_invoices").alias("total_invoices"))
    methods = reports.payment_methods(inv).groupBy("tenant_id").agg(
        F.sum("total_revenue").alias("total_revenue"), F.sum("total_invoices").alias("total_invoices"))
    assert _by_tenant(daily, "total_revenue", "total_invoices") == summary
    assert _by_tenant(methods, "total_revenue", "total_invoices") == summary


def test_all_tenants_form_filtered_equals_single_tenant(inv):
    t = inv.select("tenant_id").first().tenant_id
    one = reports.sales_summary(inv, tenant_id=t).first()
    allt = reports.sales_summary(inv).filter(F.col("tenant_id") == t).first()
    assert tuple(one) == tuple(allt)[1:]
    lines = B.invoice_lines(inv.sparkSession, SF)
    prods = B.products(inv.sparkSession, SF)
    top_one = [tuple(r) for r in reports.top_products(inv, lines, prods, tenant_id=t).collect()]
    top_all = [tuple(r)[1:3 + 1] for r in reports.top_products(inv, lines, prods)
               .filter(F.col("tenant_id") == t).orderBy("rank").collect()]
    assert top_one == top_all
    assert len(top_one) <= reports.TOP_K


def test_summary_zero_row_when_empty_and_v1_nulls(inv):
    r = reports.sales_summary(inv, tenant_id=999).collect()
    assert len(r) == 1 and r[0].total_invoices == 0 and r[0].total_revenue == 0
    r1 = reports.sales_summary_v1(inv, tenant_id=999).collect()
    assert r1[0].total_invoices == 0 and r1[0].total_revenue is None


def test_end_date_includes_next_midnight(spark):
    rows = [(1, 1, 1, D("10.00"), D("1.00"), D("0.00"), "cash", "paid", dt.datetime(2024, 1, 2, 0, 0)),
            (2, 1, 1, D("20.00"), D("2.00"), D("0.00"), "cash", "paid", dt.datetime(2024, 1, 2, 0, 0, 1)),
            (3, 1, 2, D("5.00"), D("0.00"), D("0.00"), "upi", "paid", dt.datetime(2023, 12, 31, 23, 59))]
    df = spark.createDataFrame(rows, "id long, tenant_id int, customer_id long, grand_total decimal(12,2), "
                                     "tax_total decimal(12,2), discount_total decimal(12,2), "
                                     "payment_method string, payment_status string, created_at timestamp_ntz")
    r = reports.sales_summary(df, tenant_id=1, start="2024-01-01", end="2024-01-01").first()
    assert r.total_invoices == 1 and r.total_revenue == D("10.00")
    r = reports.sales_summary(df, tenant_id=1, customer_id=2).first()
    assert r.total_invoices == 1
    days = [x.sale_date for x in reports.daily_sales(df, tenant_id=1).collect()]
    assert days == sorted(days, reverse=True)


def test_top_products_subtracts_percent_as_amount_and_merges_names(spark):
    inv = spark.createDataFrame([(1, 1, 1, dt.datetime(2024, 1, 1), "paid")],
                                "id long, tenant_id int, customer_id long, created_at timestamp_ntz, "
                                "payment_status string")
    lines = spark.createDataFrame(
        [(1, 10, D("2.000"), D("50.00"), D("10.00")), (1, 11, D("1.000"), D("30.00"), None)],
        "invoice_id long, product_id long, quantity decimal(12,3), unit_price decimal(12,2), "
        "discount decimal(12,2)")
    prods = spark.createDataFrame([(10, "Tea"), (11, "Tea")], "id long, name string")
    r = reports.top_products(inv, lines, prods, tenant_id=1).collect()
    assert len(r) == 1 and r[0].product_name == "Tea"
    assert r[0].total_revenue == D("120.00000")   # 100 - 10 (percent read as amount) + 30
    assert r[0].total_qty == D("3.000")
    r1 = reports.top_products_v1(inv, lines, prods, tenant_id=1).collect()
    assert [x.product_id for x in r1] == [10, 11]


def test_all_tenants_summary_has_zero_rows(spark, inv):
    tenants = spark.createDataFrame([(t,) for t in range(30)], "id int")
    out = {r.tenant_id: r for r in reports.sales_summary(inv, tenants=tenants).collect()}
    assert len(out) == 30
    assert out[29].total_invoices == 0 and out[29].total_revenue == 0
    single = reports.sales_summary(inv, tenant_id=29).first()
    assert tuple(single) == tuple(out[29])[1:]
