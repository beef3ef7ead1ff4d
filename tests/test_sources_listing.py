import datetime as dt
import json
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillkit.functions import predicates as P
from tillkit.operators import access, listing, pricing
from tillkit.sources import binding as B
from tillkit.sources import seeds
from tillkit.sources.schemas import items_json, parse_items
from tillkit.sources.tables import append_partitioned, as_json_rows


def test_items_json_round_trip_and_explode(spark):
    text = json.dumps([{"product_id": 5, "quantity": 2.5, "unit_price": 10.1, "discount": 0.0,
                        "discount_type": "percent", "tax_percent": 18.0},
                       {"product_id": 6, "quantity": 1.2346, "unit_price": 3}])
    df = spark.createDataFrame([(1, 7, text)], "request_id long, tenant_id int, items_text string")
    parsed = df.withColumn("items", parse_items(F.col("items_text")))
    it = parsed.first().items
    assert it[0].quantity == D("2.500") and it[0].unit_price == D("10.10")
    assert it[1].quantity == D("1.2346")         # items keep 4 places; more fail the query, none are cut
    with pytest.raises(Exception, match="does not fit"):
        df.select(parse_items(F.lit(text.replace("1.2346", "1.23456")))).collect()
    assert it[1].discount_type is None
    rows = pricing.explode_items(parsed).collect()
    assert [(r.request_id, r.product_id) for r in rows] == [(1, 5), (1, 6)]
    back = json.loads(parsed.select(items_json(F.col("items")).alias("j")).first().j)
    assert back[0]["product_id"] == 5 and back[1]["unit_price"] == 3.0


def test_append_partitioned_and_json_rows(spark, scratch):
    inv = spark.createDataFrame([(1, 3, "a"), (2, 4, "b"), (3, 3, "c")], "id long, tenant_id int, x string")
    path = os.path.join(scratch, "inv")
    append_partitioned(inv, path)
    append_partitioned(inv.filter("id = 2"), path)
    back = spark.read.parquet(path)
    assert back.count() == 4
    assert sorted(os.listdir(path))[:2] == ["_SUCCESS", "tenant_id=3"] or "tenant_id=3" in os.listdir(path)
    pruned = back.filter(F.col("tenant_id") == 4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in pruned
    js = [json.loads(r.json) for r in as_json_rows(inv.filter("id = 1")).collect()]
    assert js == [{"id": 1, "tenant_id": 3, "x": "a"}]


def test_listings(spark):
    tenants = B.tenants(spark, "/root/testdata/sf0.001")
    ids = [r.id for r in listing.list_tenants(tenants).collect()]
    assert ids == sorted(ids) and len(ids) == 25
    bt = [r.label for r in listing.list_business_types(seeds.business_types(spark)).collect()]
    assert bt == sorted(bt)
    feats = B.tenant_features(spark, "/root/testdata/sf0.001")
    got = {(r.feature_key, r.enabled) for r in listing.tenant_features(feats, tenant_id=0).collect()}
    assert got == {("kot", True), ("table_mgmt", True), ("barcode", False)}   # tenant 0: restaurant
    uoms = seeds.uom_templates(spark).unionByName(spark.createDataFrame(
        [(100, "Tray", "TRY", 5, True), (101, "Old", "OLD", 5, False)], seeds.UOM_SCHEMA))
    assert [r.name for r in listing.list_uom(uoms).collect()][:3] == ["Bag", "Bottle", "Box"]
    assert [r.name for r in listing.list_uom(uoms, 5).collect()] == ["Tray"]
    hsn = [r.hsn_code for r in listing.list_hsn(seeds.hsn_templates(spark)).collect()]
    assert hsn == sorted(hsn) and len(hsn) == 10
    cats = seeds.category_templates(spark).unionByName(spark.createDataFrame(
        [(60, "Own", None, 5, 2, True), (61, "Child", 60, 5, 2, True), (62, "Global", None, None, None, True)],
        seeds.CATEGORY_SCHEMA))
    assert [r.name for r in listing.list_categories(cats, 5).collect()] == ["Own", "Child"]
    tmpl = listing.list_categories(cats, None, 2).collect()
    assert len(tmpl) == 10 and all(r.business_type_id == 2 for r in tmpl)
    shared = listing.list_categories_shared(cats, 5, 2).collect()
    assert {r.name for r in shared} >= {"Own", "Child", "Global", "Cakes"}
    assert shared[-1].name == "Global"                      # business type NULLS LAST
    tables = spark.createDataFrame([(2, 1, "2", 4, False), (1, 1, "1", 4, True), (3, 2, "1", 2, False)],
                                   "id long, tenant_id int, table_number string, capacity int, is_occupied boolean")
    assert [r.id for r in listing.list_tables(tables, 1).collect()] == [1, 2]
    inv = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1)), (2, 1, None), (3, 2, dt.datetime(2024, 1, 2))],
                                "id long, tenant_id int, created_at timestamp_ntz")
    assert [r.id for r in listing.list_invoices(inv, 1).collect()] == [2, 1]   # NULL first in DESC
    assert [r.id for r in listing.get_invoice(inv, 3, 2).collect()] == [3]
    assert listing.get_invoice(inv, 3, 1).count() == 0


def test_predicates(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5, 2), (3, 6, 3)],
                               "id int, tenant_id int, business_type_id int")
    ids = lambda p: sorted(r.id for r in df.filter(p).collect())
    assert ids(P.strict_scope(None)) == [1] and ids(P.strict_scope(5)) == [2]
    assert ids(P.shared_scope(5)) == [1, 2]
    assert ids(P.business_type_scope(2)) == [1, 2]
    assert ids(P.business_type_scope(2, include_global=False)) == [2]
    assert ids(P.business_type_scope(None)) == [1, 2, 3]
    assert ids(P.admin_override("id", 3, None)) == [3] and ids(P.admin_override("id", 3, 5)) == []
    assert ids(P.tenant_is(None)) == []


def test_tenants_with_features(spark):
    d = "/root/testdata/sf0.001"
    rows = access.tenants_with_features(B.tenants(spark, d), B.tenant_features(spark, d), "restaurant").collect()
    assert rows and all(r.business_type == "restaurant" for r in rows)
    assert {r.feature_key for r in rows} == {"kot", "table_mgmt", "barcode"}


def test_first_row_some_rows_and_as_of(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "id int")
    assert [r.id for r in listing.first_row(df, "id").collect()] == [1]
    assert listing.first_row(df.filter("id > 5"), "id").count() == 0
    assert [r.id for r in listing.some_rows(df, 2, F.col("id").desc()).collect()] == [3, 2]
    from tillkit.sources.schemas import INVOICE_REQUEST
    req = spark.createDataFrame([(1, 1, None, None, [], "cash", D("0"), "Paid", None, None, None, None, None)],
                                INVOICE_REQUEST)
    stamped = pricing.price_invoices(req, as_of=dt.datetime(2024, 2, 3, 4, 5)).first()
    assert stamped.created_at == dt.datetime(2024, 2, 3, 4, 5)
    assert pricing.price_invoices(req.drop("created_at")).first().created_at is not None
