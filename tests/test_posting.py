import datetime as dt
import os
from decimal import Decimal as D

from pyspark.sql import functions as F


from tillkit.operators import numbering, pricing
from tillkit.plans import posting, stored
from tillkit.sources import binding as B
from tillkit.sources.schemas import INVOICE_REQUEST

T0 = dt.datetime(2024, 3, 1, 9, 0)


def _req(spark, rows):
    return spark.createDataFrame(
        [(rid, t, None, None, items, "cash", D("0"), "Paid", None, None, None, None, ts)
         for rid, t, items, ts in rows], INVOICE_REQUEST)


def it(pid, q, p):
    return (pid, D(q), D(p), None, None, D("0"))


def test_post_batches_and_rerun(spark, scratch):
    path = os.path.join(scratch, "invoices")
    b1 = _req(spark, [(1, 1, [it(10, "2", "5.00")], T0), (2, 1, [it(11, "1", "3.00")], T0 + dt.timedelta(hours=1)),
                      (3, 2, [], T0)])
    got1 = {r.request_id: r for r in posting.post_invoices(spark, b1, path, 1).collect()}
    assert {r.id for r in got1.values()} == {1, 2, 3}
    assert got1[1].invoice_number == "INV-1-20240301-0001" and got1[2].invoice_number == "INV-1-20240301-0002"
    assert got1[1].grand_total == D("10.00")

    b2 = _req(spark, [(9, 1, [it(10, "1", "5.00")], T0 + dt.timedelta(hours=2))])
    got2 = posting.post_invoices(spark, b2, path, 2).first()
    assert got2.id == 4 and got2.invoice_number == "INV-1-20240301-0003"

    again = posting.post_invoices(spark, b2, path, 2).first()          # rerun: replaced, not added
    assert again.id == 4 and again.invoice_number == "INV-1-20240301-0003"
    assert spark.read.parquet(path).count() == 4

    products = spark.createDataFrame([(10, 1, "a", D("100.000")), (11, 1, "b", D("5.000"))],
                                     "id long, tenant_id int, name string, stock_qty decimal(12,3)")
    snap = {r.id: r.stock_qty for r in posting.stock_snapshot(spark, products, path).collect()}
    assert snap == {10: D("97.000"), 11: D("4.000")}
    snap2 = {r.id: r.stock_qty for r in posting.stock_snapshot(spark, products, path).collect()}
    assert snap2 == snap


def test_numbering_moves_no_items(spark, scratch, monkeypatch):
    """What is sorted and kept for ids and numbers holds keys and times only."""
    seen, keep = [], numbering.materialize
    for module in (numbering, posting):
        monkeypatch.setattr(module, "materialize", lambda df: seen.append(set(df.columns)) or keep(df))
    path = os.path.join(scratch, "invoices")
    rows = [(i, 1, [it(10, "1", "5.00")], T0 + dt.timedelta(hours=i)) for i in (1, 2)]
    posting.post_invoices(spark, _req(spark, rows), path, 1)
    posting.post_invoices(spark, _req(spark, rows[1:]), path, 1)
    got = spark.read.parquet(path).first()
    assert (got.request_id, got.id, got.invoice_number, len(got["items"])) == (2, 2, "INV-1-20240301-0002", 1)
    assert len(seen) >= 4 and not any("items" in columns for columns in seen)


def test_requests_that_repeat_or_lack_an_id_are_all_posted(spark, scratch):
    path = os.path.join(scratch, "invoices")
    rows = [(i, 1, [it(10, q, "1.00")], T0) for i, q in ((5, "1"), (5, "2"), (None, "3"), (None, "4"), (6, "5"))]
    df = _req(spark, [(r[0] or 0, *r[1:]) for r in rows]).withColumn("request_id", F.expr("nullif(request_id, 0)"))
    got = posting.post_invoices(spark, df, path, 1).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5]
    assert sorted(int(r.invoice_number[-4:]) for r in got) == [1, 2, 3, 4, 5]
    assert sorted(r.grand_total for r in got) == [D(x) for x in (1, 2, 3, 4, 5)]
    assert sorted((r.request_id or 0) for r in got) == [0, 0, 5, 5, 6]


def test_batches_group_their_lines_once(spark, monkeypatch):
    """The plans over posted batches build the requests once, not once per batch."""
    built = spark.sparkContext.accumulator(0)
    few = B.invoice_requests(spark, "/root/testdata/sf0.001").where("request_id < 200")

    def seen(i):
        built.add(1)
        return i

    monkeypatch.setattr(B, "invoice_requests", lambda s, d: few.withColumn("request_id", F.udf(seen, "long")("request_id")))
    got = spark.read.parquet(stored._posted(spark, "/root/testdata/sf0.001"))
    cancelled = few.where("year(created_at) in (1994, 1995) and invoice_status = 'Cancelled'").count()
    assert got.count() == few.count() - cancelled and built.value == few.count()


def test_bucketed_requests_do_not_move_to_their_numbers(spark, scratch, monkeypatch):
    """Requests kept in buckets are read there: only keys and numbers are exchanged."""
    rows = [(i, 1 + i % 2, [it(10, "1", f"{i}.00")], T0 + dt.timedelta(hours=i % 7)) for i in range(1, 60)]
    kept = posting.keep_requests(_req(spark, rows + rows[:3]), os.path.join(scratch, "kept-requests"), buckets=4)
    plans, price = [], pricing.price_invoices
    monkeypatch.setattr(posting.pricing, "price_invoices", lambda *a, **k: plans.append(price(*a, **k)) or plans[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = posting.post_invoices(spark, kept, os.path.join(scratch, "invoices"), 1).collect()
        text = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        posting.drop_requests(spark, os.path.join(scratch, "kept-requests"))
    assert len(got) == 62 and sorted(r.id for r in got) == [*range(1, 63)]
    assert all(r.grand_total == r.request_id for r in got)
    assert not os.path.exists(os.path.join(scratch, "kept-requests"))
    first_side = text.split("SortMergeJoin [_at")[1].split("Bucketed: true")
    assert len(first_side) > 1 and "Exchange" not in first_side[0]
