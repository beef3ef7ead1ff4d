from decimal import Decimal as D

import datetime as dt
import pytest
from pyspark.sql import functions as F

from tillkit.operators import pricing
from tillkit.sources import binding as B
from tillkit.sources.schemas import INVOICE_REQUEST, INVOICE_LINE

T0 = dt.datetime(2024, 5, 1, 10, 0, 0)


def item(pid=1, qty="1", price="100.00", disc=None, dtype=None, tax=None):
    return (pid, D(qty), D(price) if price is not None else None,
            D(disc) if disc is not None else None, dtype, D(tax) if tax is not None else None)


def req(rid, items, tenant=1, paid="0", meta=None, status="Paid", ts=T0):
    return (rid, tenant, 7, 9, items, "cash", D(paid), status, None, meta, None, None, ts)


def price(spark, rows, version="v3"):
    df = spark.createDataFrame(rows, INVOICE_REQUEST)
    return {r["id"]: r for r in pricing.price_invoices(df, version).collect()}


def test_empty_items_price_to_zero(spark):
    r = price(spark, [req(1, [])])[1]
    assert (r.subtotal, r.discount_total, r.tax_total, r.grand_total) == (D("0.00"),) * 4
    assert r.balance == 0


def test_fixed_and_percent_lines_v3(spark):
    items = [item(qty="2", price="50.00", disc="10", dtype="percent", tax="5"),   # 100, -10, tax 4.5
             item(qty="1", price="20.00", disc="3", tax="10")]                     # fixed: 20, -3, 1.7
    r = price(spark, [req(1, items, paid="50", meta='{"bill_discount": 5}')])[1]
    assert r.subtotal == D("120.00")
    assert r.discount_total == D("18.00")          # 10 + 3 + bill 5
    assert r.tax_total == D("6.20")                # bill discount does not lower tax
    assert r.grand_total == D("108.20")            # 120 - 13 - 5 + 6.2
    assert r.balance == D("58.2")


def test_bill_discount_above_total_floors_at_zero(spark):
    r = price(spark, [req(1, [item(price="10.00")], paid="4", meta='{"bill_discount": 50}')])[1]
    assert r.grand_total == D("0.00") and r.balance == D("-4")
    v2 = price(spark, [req(1, [item(price="10.00", disc="20", dtype="fixed")])], "v2")[1]
    assert v2.grand_total == D("-10.00")          # v2 has no floor


def test_default_discount_type_per_version(spark):
    rows = [req(1, [item(price="200.00", disc="10")])]
    assert price(spark, rows, "v3")[1].discount_total == D("10.00")   # fixed
    assert price(spark, rows, "v2")[1].discount_total == D("20.00")   # percent
    pct = [req(1, [item(price="200.00", disc="10", dtype="percent")])]
    assert price(spark, pct, "v1")[1].discount_total == D("10.00")    # always an amount


def test_null_price_poisons_totals(spark):
    rows = [req(1, [item(price=None, disc="10", dtype="percent"), item(price="5.00")])]
    r = price(spark, rows)[1]
    assert r.subtotal is None and r.tax_total is None and r.discount_total is None
    assert r.grand_total == D("0.00")              # GREATEST(0, NULL) = 0
    r2 = price(spark, rows, "v2")[1]
    assert r2.grand_total is None and r2.balance is None


def test_rounding_each_total_on_store(spark):
    # line 0.33 * 0.333 = 0.10989; tax 18% of it = 0.0197802
    r = price(spark, [req(1, [item(qty="0.333", price="0.33", tax="18")], paid="0")])[1]
    assert r.subtotal == D("0.11") and r.tax_total == D("0.02")
    assert r.grand_total == D("0.13")              # 0.1296702 rounded
    assert r.balance == D("0.1296702")             # unrounded grand total


def test_exact_decimal_no_scale_loss(spark):
    r = price(spark, [req(1, [item(qty="3.333", price="1234567.89", disc="12.5",
                                   dtype="percent", tax="18")])])[1]
    lt = D("1234567.89") * D("3.333")
    disc = lt * D("12.5") / 100
    tax = (lt - disc) * D("18") / 100
    assert r.balance == lt - disc + tax


@pytest.mark.parametrize("version", ["v1", "v2", "v3"])
def test_nested_equals_normalised_on_bound_data(spark, version):
    d = "/root/testdata/sf0.001"
    nested = pricing.price_invoices(B.invoice_requests(spark, d), version).drop("items")
    flat = pricing.price_invoice_lines(B.invoice_headers(spark, d), B.invoice_lines(spark, d),
                                       version)
    cols = [c for c in flat.columns if c != "metadata"]
    assert nested.select(cols).exceptAll(flat.select(cols)).count() == 0
    assert flat.select(cols).exceptAll(nested.select(cols)).count() == 0


def test_lines_form_handles_empty_and_null(spark):
    hdr = spark.createDataFrame([req(1, []), req(2, []), req(3, [])], INVOICE_REQUEST).drop("items")
    lines = spark.createDataFrame(
        [(2, 1) + item(price="10.00"), (3, 1) + item(price=None)], INVOICE_LINE)
    out = {r.id: r for r in pricing.price_invoice_lines(hdr, lines).collect()}
    assert out[1].subtotal == D("0.00")
    assert out[2].subtotal == D("10.00")
    assert out[3].subtotal is None and out[3].grand_total == D("0.00")


def test_invoice_numbers_skew_safe_equals_window(spark):
    hdr = B.invoice_headers(spark, "/root/testdata/sf0.001").select(
        F.col("request_id").alias("id"), "tenant_id", "created_at")
    a = pricing.number_invoices(hdr, skew_safe=True)
    b = pricing.number_invoices(hdr, skew_safe=False)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_invoice_numbers_hot_group_and_lpad(spark):
    # one (tenant, day) with 10,001 invoices: numbering spans many blocks and
    # sequence 10000 truncates to '1000' like LPAD in PostgreSQL
    df = spark.range(1, 10002).select(F.col("id"), F.lit(3).alias("tenant_id"),
                                      F.lit(T0).cast("timestamp_ntz").alias("created_at"))
    out = pricing.number_invoices(df, skew_safe=True)
    got = {r.id: r.invoice_number for r in out.filter(F.col("id").isin(1, 9999, 10000, 10001)).collect()}
    assert got[1] == "INV-3-20240501-0001"
    assert got[9999] == "INV-3-20240501-9999"
    assert got[10000] == "INV-3-20240501-1000"
    assert got[10001] == "INV-3-20240501-1000"
    assert out.select("invoice_number").count() == 10001


def test_invoice_numbers_continue_from_existing(spark):
    new = spark.createDataFrame([(10, 1, T0), (11, 1, T0 + dt.timedelta(hours=1)), (12, 2, T0)],
                                "id long, tenant_id int, created_at timestamp_ntz")
    old = spark.createDataFrame([(1, 1, T0 - dt.timedelta(hours=2)), (2, 1, T0 - dt.timedelta(days=1))],
                                "id long, tenant_id int, created_at timestamp_ntz")
    got = {r.id: r.invoice_number for r in pricing.number_invoices(new, existing=old).collect()}
    assert got == {10: "INV-1-20240501-0002", 11: "INV-1-20240501-0003", 12: "INV-2-20240501-0001"}


def test_stock_deduction_rules(spark):
    products = spark.createDataFrame(
        [(1, 1, "a", D("10.000")), (2, 1, "b", D("5.000")), (1, 2, "a2", D("7.000")),
         (3, 1, "c", D("1.000"))],
        "id long, tenant_id int, name string, stock_qty decimal(12,3)")
    lines = spark.createDataFrame(
        [(1, 1, D("3")), (1, 1, D("20")), (2, 1, None), (9, 1, D("1")), (1, 2, D("1"))],
        "product_id long, tenant_id int, quantity decimal(12,3)")
    got = {(r.id, r.tenant_id): r.stock_qty for r in pricing.deduct_stock(products, lines).collect()}
    assert got[(1, 1)] == D("-13.000")     # no floor at zero
    assert got[(2, 1)] is None             # NULL quantity poisons the update
    assert got[(1, 2)] == D("6.000")       # matched on product and tenant
    assert got[(3, 1)] == D("1.000")       # unsold unchanged; unknown product 9 ignored


def test_units_sold_equal_units_in_lines(spark):
    d = "/root/testdata/sf0.001"
    hdr = B.invoice_headers(spark, d).select("request_id", "tenant_id")
    lines = B.invoice_lines(spark, d)
    sold = lines.join(hdr, lines.invoice_id == hdr.request_id)
    prods = B.products(spark, d)
    after = pricing.deduct_stock(prods, sold)
    before_sum = prods.agg(F.sum("stock_qty")).first()[0]
    after_sum = after.agg(F.sum("stock_qty")).first()[0]
    units = (sold.join(prods, (sold.product_id == prods.id) & (sold.tenant_id == prods.tenant_id))
             .agg(F.sum("quantity")).first()[0]) or 0
    assert before_sum - after_sum == units


def test_settle_only_owned_invoices(spark):
    inv = spark.createDataFrame(
        [(1, 1, D("100.00"), D("0.00"), D("100"), "Draft"), (2, 1, D("50.00"), D("0.00"), D("50"), "Draft")],
        "id long, tenant_id int, grand_total decimal(12,2), paid_amount decimal(12,2), "
        "balance decimal(38,13), invoice_status string")
    req = spark.createDataFrame([(1, 1), (2, 9)], "id long, tenant_id int")
    got = {r.id: r for r in pricing.settle_invoices(inv, req).collect()}
    assert got[1].invoice_status == "Paid" and got[1].paid_amount == D("100.00") and got[1].balance == 0
    assert got[2].invoice_status == "Draft" and got[2].balance == D("50")


def test_items_as_json_text(spark):
    import json

    text = json.dumps([{"product_id": 1, "quantity": 2, "unit_price": 50, "discount": 10,
                        "discount_type": "percent", "tax_percent": 5}])
    df = spark.createDataFrame([(1, 1, None, None, text, "cash", D("0"), "Paid", None, None, None, None, T0)],
                               "request_id long, tenant_id int, user_id long, customer_id long, items string, "
                               "payment_method string, paid_amount decimal(12,2), invoice_status string, "
                               "notes string, metadata string, table_id long, kot_id long, "
                               "created_at timestamp_ntz")
    r = pricing.price_invoices(df).first()
    assert (r.subtotal, r.discount_total, r.tax_total, r.grand_total) == (
        D("100.00"), D("10.00"), D("4.50"), D("94.50"))
    assert [x.product_id for x in pricing.explode_items(df).collect()] == [1]


# ------------------------------------------------------------ item scale

def test_five_places_are_not_rounded(spark):
    """1000 x 1.00005 is 1000.05: more places than an item holds fail, none are cut."""
    base = "select 1L request_id, 1 tenant_id, 1L customer_id, 1L user_id, 'cash' payment_method, 0.00BD paid_amount, " \
           "'Paid' invoice_status, null notes, '{}' metadata, null table_id, null kot_id, timestamp_ntz'2024-01-01' created_at"
    req = spark.sql(base)
    text = '[{"product_id":1,"quantity":%s,"unit_price":%s,"discount":%s,"tax_percent":%s}]'
    for values, ok in ((("1000", "1.0001", "0", "0"), True), (("1000", "1.00005", "0", "0"), False),
                       (("1.00001", "1", "0", "0"), False), (("1", "1", "0.12345", "0"), False),
                       (("1", "1", "0", "12.34567"), False), (("1", "1.00000", "0", "5.00"), True),
                       (("99999999999", "1", "0", "0"), False)):
        priced = pricing.price_invoices(req.withColumn("items", F.lit(text % values)))
        if ok:
            assert priced.first().subtotal == (D(values[0]) * D(values[1])).quantize(D("0.01"))
        else:
            with pytest.raises(Exception, match="does not fit"):
                priced.collect()


def test_wide_lines_must_fit(spark):
    lines = spark.createDataFrame([(1, 1, D("1000"), D("1.00005"), None, None, D("0"))],
                                  "invoice_id long, product_id long, quantity decimal(20,6), unit_price decimal(20,6), "
                                  "discount decimal(20,6), discount_type string, tax_percent decimal(20,6)")
    with pytest.raises(Exception, match="does not fit"):
        pricing.line_totals(lines).collect()
    fits = lines.withColumn("unit_price", F.lit("1.0005").cast("decimal(20,6)"))
    assert pricing.line_totals(fits).first()._sub == D("1000.5")
