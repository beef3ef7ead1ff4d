import pytest

from tillkit.operators import listing, reports
from tillkit.plans import sql_functions
from tillkit.plans.catalog import priced
from tillkit.sources import binding as B

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    inv = priced(spark, SF)
    lines, prods, custs = B.invoice_lines(spark, SF), B.products(spark, SF), B.customers(spark, SF)
    sql_functions.register(spark, inv, lines, prods, custs)
    return inv, lines, prods, custs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reports_equal_dataframe_operators(spark, views):
    inv, lines, prods, _ = views
    t = inv.select("tenant_id").first().tenant_id
    assert rows(spark.sql(f"SELECT * FROM report_sales_summary({t})")) == rows(
        reports.sales_summary(inv, tenant_id=t))
    got = spark.sql(f"SELECT * FROM report_daily_sales({t}, DATE'1995-01-01', DATE'1996-06-30')")
    want = reports.daily_sales(inv, tenant_id=t, start="1995-01-01", end="1996-06-30")
    assert rows(got) == rows(want)
    got = spark.sql(f"SELECT * FROM report_payment_methods(p_tenant_id => {t})")
    assert rows(got) == rows(reports.payment_methods(inv, tenant_id=t))
    got = spark.sql(f"SELECT * FROM report_top_products({t})")
    assert rows(got) == rows(reports.top_products(inv, lines, prods, tenant_id=t))


def test_listings_and_pushdown(spark, views):
    _, _, prods, custs = views
    got = [r.id for r in spark.sql("SELECT * FROM list_products(3)").collect()]
    assert got == [r.id for r in listing.list_products(prods, 3).collect()]
    plan = spark.sql("SELECT * FROM list_customers(3)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_nationkey,3)" in plan
    inv_id = spark.sql("SELECT id, tenant_id FROM invoices LIMIT 1").first()
    assert spark.sql(f"SELECT * FROM get_invoice({inv_id.id}, {inv_id.tenant_id})").count() == 1
    assert spark.sql(f"SELECT * FROM get_invoice({inv_id.id}, 99)").count() == 0


def test_calls_per_row_equal_the_reports(spark, views):
    inv, lines, prods, _ = views
    B.tenants(spark, SF).createOrReplaceTempView("tenants")
    each = lambda f: spark.sql(f"SELECT t.id AS tenant_id, r.* FROM tenants t, LATERAL {f}(t.id) r")
    assert rows(each("tenant_daily_sales")) == rows(reports.daily_sales(inv))
    assert rows(each("tenant_sales_summary")) == rows(reports.sales_summary(inv, tenants=B.tenants(spark, SF)))
    top = reports.top_products(inv, lines, prods).drop("rank")
    assert rows(each("tenant_top_products")) == rows(top.select(each("tenant_top_products").columns))
    v1 = spark.sql("SELECT * FROM report_sales_summary_v1(3)").first()
    want = reports.sales_summary_v1(inv, tenant_id=3).first()
    assert all(v1[c] == want[c] for c in want.asDict())
