"""Behaviour at the edges: schemas that change, exact inputs, repeated requests."""

import datetime as dt
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillkit.operators import listing, pricing
from tillkit.operators import maintenance as M
from tillkit.operators.numbering import sequence_within
from tillkit.plans import posting
from tillkit.sources import seeds
from tillkit.sources.schemas import INVOICE_REQUEST
from tillkit.sources.tables import read_table

T0 = dt.datetime(2024, 3, 1, 9, 0)


def test_rewritten_table_shows_its_new_column(spark, scratch):
    path = os.path.join(scratch, "t.parquet")
    spark.range(3).write.parquet(path)
    assert read_table(spark, scratch, "t").columns == ["id"]
    spark.range(3).withColumn("more", F.lit(1)).write.mode("overwrite").parquet(path)
    assert read_table(spark, scratch, "t").columns == ["id", "more"]


def _price(spark, items, version="v3"):
    req = spark.createDataFrame([(1, 1, items, "cash", D("0"), "Paid", "{}", None, None, None, None, T0)],
                                "request_id long, tenant_id int, items string, payment_method string, "
                                "paid_amount decimal(12,2), invoice_status string, metadata string, notes string, "
                                "table_id long, kot_id long, user_id long, created_at timestamp_ntz"
                                ).withColumn("customer_id", F.lit(None).cast("long"))
    return pricing.price_invoices(req, version)


def test_inputs_are_not_rounded_before_pricing(spark):
    row = _price(spark, '[{"product_id":1,"quantity":2,"unit_price":1.005}]').first()
    assert row.subtotal == D("2.01")
    row = _price(spark, '[{"product_id":1,"quantity":1,"unit_price":20.00,"discount":12.345,'
                        '"discount_type":"percent","tax_percent":18}]').first()
    assert row.balance == D("20.68658") and row.grand_total == D("20.69")
    row = _price(spark, '[{"product_id":1,"quantity":0.1234,"unit_price":10.0001,"tax_percent":12.3456}]').first()
    assert row.balance == D("0.1234") * D("10.0001") * (1 + D("0.123456"))


@pytest.mark.parametrize("bad", ['[{"product_id":1,"quantity":2,"unit_price"', '[{"quantity":1,"unit_price":"ten"}]'])
def test_unreadable_items_fail(spark, bad):
    with pytest.raises(Exception, match="MALFORMED|malformed|PARSE"):
        _price(spark, bad).collect()


def _post(spark, path, batch, rows):
    req = spark.createDataFrame(
        [(rid, 1, None, None, [(10, D("1"), D("5"), None, None, None)], "cash", D("0"), "Paid", None, None, None, None,
          T0 + dt.timedelta(minutes=rid)) for rid in rows], INVOICE_REQUEST)
    return {r.request_id: (r.id, r.invoice_number) for r in posting.post_invoices(spark, req, path, batch).collect()}


def test_rerun_of_an_earlier_batch_keeps_ids_and_numbers(spark, scratch):
    path = os.path.join(scratch, "inv")
    first = _post(spark, path, 1, [1, 2])
    second = _post(spark, path, 2, [3, 4])
    assert _post(spark, path, 1, [1, 2]) == first
    assert _post(spark, path, 2, [3, 4]) == second
    more = _post(spark, path, 1, [1, 2, 5])
    assert {k: more[k] for k in first} == first and more[5] == (5, "INV-1-20240301-0005")
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("id").distinct().count() == 5


def test_only_a_missing_path_means_nothing_stored(spark, scratch):
    path = os.path.join(scratch, "broken")
    os.makedirs(path)
    with open(os.path.join(path, "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        posting.stock_snapshot(spark, spark.range(1), path).collect()


def test_toggle_once_for_several_requests(spark):
    users = spark.createDataFrame([(5, 3, True), (6, 3, True), (7, 3, None)], "id long, tenant_id int, is_active boolean")
    req = spark.createDataFrame([(5, None), (5, 3), (5, 3), (6, 4), (7, 3)], "id long, tenant_id int")
    got = sorted((r.id, r.is_active) for r in M.toggle_active(users, req).collect())
    assert got == [(5, False), (6, True), (7, None)]


def test_second_change_of_a_key_fails(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "id long, name string")
    for op in (lambda: M.patch(table, twice, ["id"]), lambda: M.upsert(table, twice, ["id"]),
               lambda: M.save_by_id(table, twice, ["name"])):
        with pytest.raises(Exception, match="several changes of one key"):
            op().collect()
    once = spark.createDataFrame([(1, "x"), (3, "z")], "id long, name string")
    assert sorted(map(tuple, M.upsert(table, once, ["id"]).collect())) == [(1, "x"), (2, "b"), (3, "z")]


def test_child_category_does_not_stand_in_for_a_top_one(spark):
    cats = spark.createDataFrame(
        [(1, "Drinks", None, None, 2, True), (2, "Tea", 1, None, 2, True),
         (3, "Shop", None, 7, 2, True), (4, "Drinks", 3, 7, 2, True)], seeds.CATEGORY_SCHEMA)
    wl = spark.createDataFrame([(7, 2)], "tenant_id int, business_type_id int")
    once = M.provision_categories(wl, cats)
    own = {(r.name, r.parent_id): r.id for r in once.filter("tenant_id = 7").collect()}
    assert ("Drinks", None) in own and ("Tea", own[("Drinks", None)]) in own
    assert M.provision_categories(wl, once).count() == once.count()


def test_masters_are_copied_from_the_table(spark):
    hsns = seeds.hsn_templates(spark)
    kind = dict(hsns.dtypes)
    extra = hsns.limit(1).withColumns({"hsn_code": F.lit("9999"), "cess_rate": F.lit(3).cast(kind["cess_rate"]),
                                       "id": F.lit(500).cast(kind["id"])})
    dead = hsns.limit(1).withColumns({"hsn_code": F.lit("0000"), "is_active": F.lit(False),
                                      "id": F.lit(501).cast(kind["id"])})
    wl = spark.createDataFrame([(10,)], "tenant_id int")
    own = M.provision_hsns(wl, hsns.unionByName(extra).unionByName(dead)).filter("tenant_id = 10")
    got = {r.hsn_code: r.cess_rate for r in own.collect()}
    assert got["9999"] == 3 and "0000" not in got


def test_look_up_of_many_invoices(spark):
    inv = spark.createDataFrame([(1, 3), (2, 4), (3, 3)], "id long, tenant_id int")
    req = spark.createDataFrame([(1, 3), (1, 3), (2, 3), (9, 3)], "id long, tenant_id int")
    assert [tuple(r) for r in listing.get_invoices(inv, req).collect()] == [(1, 3)]


def test_numbering_has_one_full_shuffle(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id")
    out = sequence_within(df, ["g"], ["id"], num_blocks=7)
    assert sorted((r.g, r.id, r.seq) for r in out.collect()) == sorted((i % 3, i, i // 3 + 1) for i in range(500))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # the sorted blocks are read back, not sorted again
