from decimal import Decimal as D

from pyspark.sql import functions as F

from tillkit.operators import aggregates, generate, quality
from tillkit.sources import seeds


def test_quality_checks(spark):
    inv = spark.createDataFrame([(1, "cash", 5), (2, "split", 5), (3, None, 6), (3, "upi", None)],
                                "id long, payment_method string, customer_id long")
    bad = quality.check_allowed(inv, "invoices", "payment_method", seeds.PAYMENT_METHODS, ["id"]).collect()
    assert [(r.row_key, r.value) for r in bad] == [("2", "split")]
    dup = quality.check_unique(inv, "invoices", ["id"]).collect()
    assert [(r.row_key, r.value) for r in dup] == [("3", "2")]
    cust = spark.createDataFrame([(5,)], "id long")
    fk = quality.check_foreign_key(inv, "invoices", ["customer_id"], cust, ["id"], ["id"]).collect()
    assert [r.row_key for r in fk] == ["3"]
    nn = quality.check_not_null(inv, "invoices", "customer_id", ["id"]).collect()
    assert [r.row_key for r in nn] == ["3"]
    sc = spark.createDataFrame([(1, D("1.234")), (2, D("1.200"))], "id int, q decimal(10,3)")
    assert [r.row_key for r in quality.check_scale(sc, "t", "q", 2, ["id"]).collect()] == ["1"]
    summ = {(r.rule): r.violations for r in quality.violation_summary(
        quality.check_unique(inv, "invoices", ["id"]).unionByName(
            quality.check_not_null(inv, "invoices", "customer_id", ["id"]))).collect()}
    assert summ == {"unique:id": 1, "not_null:customer_id": 1}


def test_aggregates(spark):
    p = spark.createDataFrame([(1, 1, "Tea", True), (2, 1, "Tea", True), (3, 2, "Milk", True), (4, 2, "Tea", False)],
                              "id long, tenant_id int, name string, is_active boolean")
    t = spark.createDataFrame([(1, "Bakery"), (2, "Bakery"), (3, "Cafe")], "id int, label string")
    assert {r.label: r.row_count for r in aggregates.count_by_label(p, t, "tenant_id").collect()} == {"Bakery": 3}
    d = aggregates.duplicates_keep_least(p, "name").collect()
    assert [(r.name, r.copies, r.keep_id) for r in d] == [("Tea", 3, 1)]
    assert sorted(r.id for r in aggregates.duplicate_rows_to_drop(p, "name").collect()) == [2, 4]
    c = spark.createDataFrame([(1, 3)], "id long, tenant_id int")
    rpt = {r.tenant_id: (r.products_count, r.customers_count)
           for r in aggregates.rows_per_tenant({"products": p, "customers": c}).collect()}
    assert rpt == {1: (2, 0), 2: (2, 0), 3: (0, 1)}


def test_generators_are_idempotent(spark):
    cats = spark.createDataFrame([(1, "Cakes", None, None, 2, True)], seeds.CATEGORY_SCHEMA)
    out = generate.seed_category_templates(cats, seeds.business_types(spark))
    assert out.count() == 1 + 49                       # 'Cakes' for bakery exists already
    assert generate.seed_category_templates(out, seeds.business_types(spark)).count() == out.count()
    by_type = {r.business_type_id: r.n for r in out.groupBy("business_type_id").agg(F.count("*").alias("n")).collect()}
    assert by_type == {1: 10, 2: 10, 3: 10, 4: 10, 5: 10}

    tenants = spark.createDataFrame([(1,), (2,)], "id int")
    prods = generate.synthetic_products(tenants)
    assert prods.count() == 200
    r = prods.filter("tenant_id = 2 AND sku = 'SKU-2-0007'").first()
    assert r.barcode == "8901234000007" and D("10") <= r.price <= D("2000")
    empty = spark.createDataFrame([], "tenant_id int, sku string")
    assert generate.seed_products(empty, tenants).count() == 200

    feats = spark.createDataFrame([(1, "table_mgmt", True), (2, "table_mgmt", False), (3, "table_mgmt", True)],
                                  "tenant_id int, feature_key string, enabled boolean")
    tables = spark.createDataFrame([(1, 3, "1", 4, False)],
                                   "id long, tenant_id int, table_number string, capacity int, is_occupied boolean")
    t2 = generate.seed_tables(tables, feats)
    assert t2.filter("tenant_id = 1").count() == 20
    assert t2.filter("tenant_id = 3").count() == 1
    numbers = [r.table_number for r in t2.filter("tenant_id = 1").orderBy("id").collect()]
    assert numbers == [str(i) for i in range(1, 21)]
    assert generate.seed_tables(t2, feats).count() == t2.count()


def test_enumeration_checks_e1_e4(spark):
    from tillkit.sources import binding as B

    tenants = B.tenants(spark, "/root/testdata/sf0.001")
    assert quality.check_allowed(tenants, "tenants", "business_type", seeds.BUSINESS_TYPES_V1, ["id"]).count() == 0
    odd = spark.createDataFrame([(1, "florist"), (2, "service"), (3, None)], "id int, business_type string")
    v1 = [r.row_key for r in quality.check_allowed(odd, "tenants", "business_type", seeds.BUSINESS_TYPES_V1, ["id"]).collect()]
    v2 = [r.row_key for r in quality.check_allowed(odd, "tenants", "business_type", seeds.BUSINESS_TYPES_V2, ["id"]).collect()]
    assert sorted(v1) == ["1", "2"] and v2 == ["1"]                    # NULL passes a CHECK
    kot = spark.createDataFrame([(1, "ready"), (2, "burnt")], "id int, status string")
    assert [r.value for r in quality.check_allowed(kot, "kot", "status", seeds.KOT_STATUSES, ["id"]).collect()] == ["burnt"]


def test_single_pass_counts_equal_separate_checks(spark):
    lines = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (2, 1, 99), (3, None, None), (3, None, 98)],
                                  "invoice_id long, line_no int, product_id long")
    prods = spark.createDataFrame([(5,), (6,)], "id long")
    separate = {r.rule: r.violations for r in quality.violation_summary(
        quality.check_unique(lines, "invoice_lines", ["invoice_id", "line_no"]).unionByName(
            quality.check_foreign_key(lines, "invoice_lines", ["product_id"], prods, ["id"],
                                      ["invoice_id", "line_no"]))).collect()}
    flagged = quality.orphan_flag(lines, "product_id", prods, "id")
    per_key = flagged.groupBy("invoice_id", "line_no").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_orphan")).alias("_o"))
    fused = {r.rule: r.violations for r in quality.violation_counts(per_key, "invoice_lines", [
        ("unique:invoice_id,line_no", F.count_if(F.col("invoice_id").isNotNull()
                                                 & F.col("line_no").isNotNull() & (F.col("_n") > 1))),
        ("fk:product_id", F.sum("_o")),
        ("never", F.count_if(F.lit(False))),
    ]).collect()}
    assert fused == separate == {"unique:invoice_id,line_no": 1, "fk:product_id": 2}


def test_item_scale_violations(spark):
    import json

    text = json.dumps([{"product_id": 1, "quantity": 1.2345, "unit_price": 10.5},
                       {"product_id": 2, "quantity": 2, "unit_price": 3.333, "tax_percent": 5}])
    req = spark.createDataFrame([(7, text)], "request_id long, items_text string")
    got = sorted((r.rule, r.row_key) for r in quality.item_scale_violations(req).collect())
    assert got == [("scale:quantity", "7|0"), ("scale:unit_price", "7|1")]
