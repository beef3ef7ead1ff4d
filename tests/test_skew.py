"""Hot keys: one key holding a third of all rows, checked against brute force."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from tillkit.operators import access, maintenance, pricing, reports
from tillkit.sources import seeds
from tillkit.sources.schemas import INVOICE_LINE

N = 3000


def _lines(spark):
    rows = []
    for i in range(N):
        inv = 1 if i < N // 3 else 2 + i % 50            # invoice 1 holds a third of the lines
        rows.append((inv, i, 7 if i % 3 == 0 else i % 40, D(1 + i % 5), D("9.99"), D(i % 4),
                     "percent" if i % 2 else None, D("5.00")))
    return rows, spark.createDataFrame(rows, INVOICE_LINE)


def test_hot_invoice_prices_exactly(spark):
    rows, lines = _lines(spark)
    tot = {r._key: r for r in pricing.line_totals(lines, "v3").collect()}
    sub = sum(q * p for inv, _, _, q, p, *_ in rows if inv == 1)
    disc = sum((q * p * d / 100) if t == "percent" else d
               for inv, _, _, q, p, d, t, _ in rows if inv == 1)
    tax = sum((q * p - ((q * p * d / 100) if t == "percent" else d)) * x / 100
              for inv, _, _, q, p, d, t, x in rows if inv == 1)
    assert (tot[1]._sub, tot[1]._disc, tot[1]._tax) == (sub, disc, tax)


def test_hot_product_top_products(spark):
    rows, lines = _lines(spark)
    inv = spark.createDataFrame([(i, 1, 1, dt.datetime(2024, 1, 1), "paid") for i in range(1, 52)],
                                "id long, tenant_id int, customer_id long, created_at timestamp_ntz, "
                                "payment_status string")
    prods = spark.createDataFrame([(i, f"p{i % 10}") for i in range(40)], "id long, name string")
    got = {r.product_name: r.total_qty for r in reports.top_products(inv, lines, prods, tenant_id=1, k=100).collect()}
    want = {}
    for _, _, pid, q, *_ in rows:
        want[f"p{pid % 10}"] = want.get(f"p{pid % 10}", 0) + q
    assert got == want


def test_hot_key_dedupe_and_stock(spark):
    rows = [(1 if i < N // 3 else i, i, f"v{i}") for i in range(N)]
    df = spark.createDataFrame(rows, "k long, pos int, v string")
    out = {r.k: r.v for r in maintenance.dedupe_first(df, ["k"], ["pos"]).collect()}
    assert out[1] == "v0" and len(out) == N - N // 3 + 1
    prods = spark.createDataFrame([(7, 1, D("100000.000"))], "id long, tenant_id int, stock_qty decimal(12,3)")
    rows, lines = _lines(spark)
    sold = lines.withColumn("tenant_id", F.lit(1))
    left = pricing.deduct_stock(prods, sold).first().stock_qty
    assert left == D("100000") - sum(q for _, _, pid, q, *_ in rows if pid == 7)


def test_hot_tenant_role_menus(spark):
    users = spark.createDataFrame([(i, 3, 70 if i % 3 == 0 else None) for i in range(N)],
                                  "id long, role_id int, tenant_role_id long")
    trp = spark.createDataFrame([(70, m, True, False, False, False) for m in (1, 2, 3)],
                                "tenant_role_id long, menu_id int, can_view boolean, can_add boolean, "
                                "can_edit boolean, can_delete boolean")
    out = access.user_menus(users, seeds.menus(spark), seeds.role_grants(spark), trp)
    per = out.groupBy("user_id").count()
    counts = {r.user_id: r["count"] for r in per.collect()}
    assert counts[0] == 3 and counts[1] == 6 and len(counts) == N


def test_aqe_splits_hot_tenant_role_join(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        users = spark.range(0, 60000).select(
            F.col("id"), F.lit(3).alias("role_id"),
            F.when(F.col("id") % 3 == 0, F.lit(70)).otherwise(F.col("id") % 997 + 100).alias("tenant_role_id"))
        trp = spark.range(100, 1097).select(F.col("id").alias("tenant_role_id"), F.lit(1).alias("menu_id"),
                                            F.lit(True).alias("can_view"), F.lit(False).alias("can_add"),
                                            F.lit(False).alias("can_edit"), F.lit(False).alias("can_delete"))
        trp = trp.unionByName(trp.limit(0).unionByName(
            spark.createDataFrame([(70, 1, True, False, False, False)],
                                  "tenant_role_id long, menu_id int, can_view boolean, can_add boolean, "
                                  "can_edit boolean, can_delete boolean")))
        out = access.user_menus(users, seeds.menus(spark), seeds.role_grants(spark), trp)
        assert len(out.collect()) == 60000
        final = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
