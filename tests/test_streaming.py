import os

import pytest


from tillkit.operators import pricing, reports
from tillkit.plans.catalog import priced
from tillkit.sources import binding as B
from tillkit.streaming import sales

SF = "/root/testdata/sf0.001"


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_daily_sales_stream_equals_batch(spark, scratch):
    inv = priced(spark, SF).select("id", "tenant_id", "grand_total", "created_at")
    src = os.path.join(scratch, "src")
    inv.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(inv.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = sales.start_daily_sales(stream, os.path.join(scratch, "sink"), os.path.join(scratch, "ck"),
                                watermark="36500 days")
    q.awaitTermination(300)
    got = sales.read_daily_sales(spark, os.path.join(scratch, "sink"))
    want = reports.daily_sales(inv).select("tenant_id", "sale_date", "total_revenue", "total_invoices")
    assert _same(got, want)


def test_invoice_posting_stream_equals_batch(spark, scratch):
    req = B.invoice_requests(spark, SF)
    src = os.path.join(scratch, "req")
    req.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    sink = os.path.join(scratch, "posted")
    q = sales.start_invoice_posting(stream, sink, os.path.join(scratch, "ck2"))
    q.awaitTermination(300)
    got = spark.read.parquet(sink).drop("batch_id")
    want = pricing.price_invoices(spark.read.parquet(src)).drop("items")
    cols = sorted(want.columns)
    assert _same(got.select(cols), want.select(cols))


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Kolkata"])
def test_daily_sales_stream_in_other_time_zone(spark, scratch, zone):
    inv = priced(spark, SF).select("id", "tenant_id", "grand_total", "created_at")
    want = reports.daily_sales(inv).select("tenant_id", "sale_date", "total_revenue", "total_invoices")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = sales.replay_daily_sales(inv, os.path.join(scratch, "tz"))
        assert _same(got, want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_line_posting_stream_equals_batch(spark, scratch):
    hdr, lines = B.invoice_headers(spark, SF), B.invoice_lines(spark, SF)
    got = sales.replay_line_posting(hdr.repartition(5), lines, os.path.join(scratch, "t2"),
                                    files_per_batch=1)
    want = pricing.price_invoice_lines(hdr, lines)
    assert spark.read.parquet(os.path.join(scratch, "t2", "sink")).select("batch_id").distinct().count() >= 3
    cols = sorted(want.columns)
    assert _same(got.select(cols), want.select(cols))


def test_posting_plan_gives_every_core_a_file(spark, monkeypatch):
    from tillkit.plans.catalog import PLANS
    from tillkit.session import ensure_checkpoint_dir

    cores = spark.sparkContext.defaultParallelism
    ask = B.invoice_requests
    monkeypatch.setattr(B, "invoice_requests", lambda s, d: ask(s, d).repartition(2 * cores))
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    rows = PLANS["T2_invoice_posting_stream"](spark, SF).count()
    (root,) = [x for x in set(os.listdir(base)) - before if x.startswith("tillkit-t2-")]
    parts = [x for x in os.listdir(os.path.join(base, root, "sink")) if x.startswith("batch_id=")]
    assert rows == ask(spark, SF).count() and len(parts) == 2  # of 2 * cores files
