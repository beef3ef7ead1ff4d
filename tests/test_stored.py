"""Posting, ledger, id ranges, partial rewrites, streams with state that leaves, variants, trees."""

import datetime as dt
import os
import threading
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillkit.operators import maintenance as M
from tillkit.operators import pricing
from tillkit.operators.ledger import StockLedger
from tillkit.operators.numbering import with_position
from tillkit.plans import posting
from tillkit.sources import binding as B
from tillkit.sources import seeds, variants
from tillkit.sources.buckets import BucketTable
from tillkit.sources.ids import IdRegister
from tillkit.sources.schemas import INVOICE_REQUEST
from tillkit.streaming import sales

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 3, 1, 9, 0)


def requests(spark, rows):
    return spark.createDataFrame(
        [(rid, t, None, None, items, "cash", D("0"), "Paid", None, None, None, None, T0 + dt.timedelta(minutes=rid))
         for rid, t, items in rows], INVOICE_REQUEST)


def item(pid, q, price="1.00"):
    return (pid, None if q is None else D(q), D(price), None, None, D("0"))


# ------------------------------------------------------------ posting

def test_numbers_after_a_rerun_that_shrank(spark, scratch):
    path = os.path.join(scratch, "inv")

    def post(batch, ids):
        posting.post_invoices(spark, requests(spark, [(i, 1, []) for i in ids]), path, batch)

    post(1, [1, 2, 3])
    post(2, [4])
    post(1, [1, 3, 5])
    post(3, [6])
    got = {r.request_id: r for r in spark.read.parquet(path).collect()}
    assert {k: r.invoice_number[-4:] for k, r in got.items()} == {1: "0001", 3: "0003", 4: "0004", 5: "0005", 6: "0006"}
    assert {k: r.id for k, r in got.items()} == {1: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    post(2, [])
    assert spark.read.parquet(path).count() == 4


def test_posting_reads_no_stored_ids(spark, scratch):
    """Ids come from the register: no plan of the id step scans the invoices."""
    path = os.path.join(scratch, "inv")
    posting.post_invoices(spark, requests(spark, [(1, 1, [])]), path, 1)
    fresh = pricing.price_invoices(requests(spark, [(2, 1, [])])).withColumnRenamed("id", "request_id")
    plan = posting._with_ids(spark, fresh, path, 2)._jdf.queryExecution().toString()
    assert path not in plan


def test_concurrent_ranges_are_disjoint(spark, scratch):
    path = os.path.join(scratch, "ids")
    got = {}

    def ask(n):
        got[n] = IdRegister(spark, path).reserve(f"b{n}", 10 + n)

    threads = [threading.Thread(target=ask, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    taken = [i for n, first in got.items() for i in range(first, first + 10 + n)]
    assert len(taken) == len(set(taken)) == sum(10 + n for n in range(6)) and min(taken) == 1
    assert max(taken) == len(taken)  # no gaps either
    again = IdRegister(spark, path)
    assert again.reserve("b3", 13) == got[3] and again.reserve("b3", 2) == got[3]
    assert again.reserve("b3", 99) == len(taken) + 1


# ------------------------------------------------------------ ledger

def lines(spark, rows):
    return spark.createDataFrame([(t, p, None if q is None else D(q)) for t, p, q in rows],
                                 "tenant_id int, product_id long, quantity decimal(13,4)")


def test_ledger_equals_all_lines_after_reruns(spark, scratch):
    products = spark.createDataFrame([(p, t, "x", D("100.000")) for p in (1, 2, 3) for t in (1, 2)],
                                     "id long, tenant_id int, name string, stock_qty decimal(12,3)")
    ledger = StockLedger(spark, scratch)
    assert ledger.stock(products).count() == 6
    batches = {1: [(1, 1, "2.5"), (1, 1, "1"), (2, 9, "4")], 2: [(1, 2, "3"), (None, 1, "7")], 3: [(2, 1, "1")]}

    def check():
        rows = [r for b in batches.values() for r in b]
        want = pricing.deduct_stock(products, lines(spark, rows))
        got = ledger.stock(products)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

    for n, rows in batches.items():
        ledger.post(n, lines(spark, rows))
    check()
    ledger.post(2, lines(spark, batches[2]))  # the same again
    check()
    batches[1] = [(1, 1, "1"), (1, 3, None)]  # other rows, one of unknown quantity
    ledger.post(1, lines(spark, batches[1]))
    check()
    batches[2] = []
    ledger.post(2, lines(spark, []))
    check()
    batches[4] = [(2, 1, "5")]
    ledger.post(4, lines(spark, batches[4]))
    check()


def test_ledger_reads_one_part_and_the_last_totals(spark, scratch):
    ledger = StockLedger(spark, scratch)
    for n in (1, 2, 3):
        ledger.post(n, lines(spark, [(1, n, "1")]))
    files = " ".join(ledger.next_totals(3, 2).inputFiles())
    assert "batch_id=3" in files and "through=2" in files
    assert not any(x in files for x in ("batch_id=1", "batch_id=2", "through=1", "through=3"))


# ------------------------------------------------------------ partial rewrites

def test_change_reads_and_writes_touched_buckets_only(spark, scratch):
    rows = spark.range(2000).select("id", (F.col("id") % 7).alias("v"), F.lit(True).alias("is_active"))
    table = BucketTable(spark, scratch, ["id"], 16)
    table.create(rows)

    def files():
        out = {}
        for folder, _, names in os.walk(os.path.join(scratch, "table")):
            for n in names:
                if n.endswith(".parquet"):
                    out.setdefault(os.path.basename(folder), set()).add((n, os.stat(os.path.join(folder, n)).st_mtime_ns))
        return out

    before = files()
    changes = spark.createDataFrame([(5, 100), (77, 101)], "id long, v long")
    touched = table.change(changes, lambda part, ch: M.patch(part, ch, ["id"]))
    after = files()
    assert 1 <= len(touched) <= 2
    assert {b for b in before if before[b] != after[b]} == {f"bucket={b}" for b in touched}
    assert {r.id: r.v for r in table.read().where("v >= 100").collect()} == {5: 100, 77: 101}
    assert table.read().count() == 2000
    plan = table.part(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = table.part(touched).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("bucket=")[1].split("/")[0] for r in read} == {str(b) for b in touched}


def test_upsert_and_toggle_by_bucket(spark, scratch):
    perms = B.tenant_role_permissions(spark, SF)
    table = BucketTable(spark, os.path.join(scratch, "a"), ["tenant_role_id"], 8)
    table.create(perms)
    ch = perms.limit(1).select("tenant_role_id", F.lit(5).alias("menu_id"), *[F.lit(True).alias(c) for c in seeds.PERMISSION_FIELDS])
    ch = spark.createDataFrame(ch.collect(), ch.schema)
    table.change(ch, lambda part, c: M.upsert(part, c, ["tenant_role_id", "menu_id"]))
    want = M.upsert(perms, ch, ["tenant_role_id", "menu_id"])
    assert sorted(map(tuple, table.read().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert table.change(ch.limit(0), lambda part, c: part) == []
    with pytest.raises(ValueError):
        BucketTable(spark, scratch, ["id"], 0)


# ------------------------------------------------------------ streams

def stream_rows(spark, days):
    """(id, tenant, total, time, slice): ``days`` of [(day, hour, tenant, slice)]."""
    return spark.createDataFrame(
        [(i, t, D("1.00"), dt.datetime(2024, 1, 1 + d, h), s) for i, (d, h, t, s) in enumerate(days)],
        "id long, tenant_id int, grand_total decimal(12,2), created_at timestamp_ntz, slice int")


def test_finished_days_leave_the_state_and_late_rows_are_dropped(spark, scratch):
    days = [(d, 9, 1, 0) for d in range(10)] + [(d, 9, 1, 1) for d in range(10, 20)] + [(2, 8, 1, 1)] + [(25, 1, 1, 2)]
    progress = sales.arrive(stream_rows(spark, days), "slice", scratch, sales.append_daily_sales)
    state = [p["stateOperators"][0] for p in progress]
    held = [s["numRowsTotal"] for s in state]
    assert max(held) > 5 and held[-1] <= 2, held
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1
    got = {r.sale_date.day: r.total_invoices for r in spark.read.parquet(f"{scratch}/sink").collect()}
    assert got == {d + 1: 1 for d in range(20)}  # day 3 once; day 26 is not over


@pytest.mark.parametrize("slices", [1, 2, 4])
def test_numbers_go_on_over_micro_batches(spark, scratch, slices):
    rows = [(d, h, t, 0) for d in range(3) for h in range(8) for t in (1, 2)]
    df = stream_rows(spark, rows).withColumn("slice", F.expr(f"int(day(created_at) * 24 + hour(created_at)) div {24 // slices}"))
    progress = sales.arrive(df, "slice", scratch, sales.start_numbering)
    got = sorted((r.id, r.invoice_number) for r in spark.read.parquet(f"{scratch}/sink").collect())
    want = pricing.number_invoices(df.select("id", "tenant_id", "created_at"))
    assert got == sorted((r.id, r.invoice_number) for r in want.collect())
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 6


def test_state_of_old_months_leaves_numbering(spark, scratch):
    rows = [(0, 9, t, 0) for t in range(6)] + [(0, 9, 1, 1), (50, 9, 1, 1), (50, 10, 1, 2), (120, 9, 1, 3)]
    df = spark.createDataFrame(
        [(i, t, dt.datetime(2024, 1, 1, h) + dt.timedelta(days=d), s) for i, (d, h, t, s) in enumerate(rows)],
        "id long, tenant_id int, created_at timestamp_ntz, slice int")
    progress = sales.arrive(df, "slice", scratch, sales.start_numbering)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) >= 6 and held[-1] == 1, held
    got = {r.id: r.invoice_number[-4:] for r in spark.read.parquet(f"{scratch}/sink").collect()}
    assert got == {**{i: "0001" for i in range(6)}, 6: "0002", 7: "0001", 8: "0002", 9: "0001"}


# ------------------------------------------------------------ variants

def test_variants_store_and_read_paths(spark, scratch):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, 2]}, "c": "x"}'), (2, None), (3, '{"a": {"b": "no"}}')], "id int, v string")
    df.select("id", variants.parsed("v")).write.parquet(os.path.join(scratch, "v"))
    got = spark.read.parquet(os.path.join(scratch, "v")).select(
        "id", variants.field("v", "$.a.b[1]", "int"), variants.field("v", "$.c", "string"), variants.as_json("v")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, "x", '{"a":{"b":[1,2]},"c":"x"}'), (2, None, None, "{}"),
                                       (3, None, None, '{"a":{"b":"no"}}')]
    with pytest.raises(Exception):
        spark.createDataFrame([("{no",)], "v string").select(variants.parsed("v")).collect()


# ------------------------------------------------------------ trees

def cats(spark, rows):
    return spark.createDataFrame([(*r, True) for r in rows], seeds.CATEGORY_SCHEMA)


def test_tree_of_any_depth_is_relinked_and_idempotent(spark):
    """Four levels, a name that occurs at two places, an own top with the same path, and a circle."""
    table = cats(spark, [(1, "a", None, None, 2), (2, "b", 1, None, 2), (3, "a", 2, None, 2), (4, "b", 3, None, 2),
                         (5, "x", 6, None, 2), (6, "y", 5, None, 2), (7, "z", 7, None, 2), (8, "other", 1, None, 3),
                         (20, "a", None, 9, 2)])
    wl = spark.createDataFrame([(9, 2), (8, 2)], "tenant_id int, business_type_id int")
    once = M.provision_categories(wl, table).cache()
    for tenant, new in ((9, 3), (8, 4)):
        own = {r.id: r for r in once.where(F.col("tenant_id") == tenant).collect()}
        paths = set()
        for r in own.values():
            path, at = [r.name], r
            while at.parent_id is not None:
                at = own[at.parent_id]
                path.insert(0, at.name)
            paths.add("/".join(path))
        assert paths == {"a", "a/b", "a/b/a", "a/b/a/b"} and len(own) == 4
    assert once.count() == table.count() + 7
    assert M.provision_categories(wl, once).count() == once.count()


def test_paths_leave_out_circles(spark):
    table = cats(spark, [(1, "a", None, None, 1), (2, "b", 1, None, 1), (3, "x", 4, None, 1), (4, "y", 3, None, 1), (5, "z", 99, None, 1)])
    assert {(r.id, "/".join(r.path), r.depth) for r in M.category_paths(table).collect()} == {(1, "a", 0), (2, "a/b", 1)}


# ------------------------------------------------------------ order as a column

def test_positions_show_where_nulls_go(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1), (4, None), (5, 5)], "id int, v int")
    for key, want in ((F.col("v").asc_nulls_first(), [1, 4, 3, 2, 5]), (F.col("v").asc_nulls_last(), [3, 2, 5, 1, 4]),
                      (F.col("v").desc_nulls_first(), [1, 4, 2, 5, 3])):
        got = with_position(df, key, F.col("id").asc())
        assert [r.id for r in sorted(got.collect(), key=lambda r: r.position)] == want


# ------------------------------------------------------------ pruned look-ups, functions per row

def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_ups_read_what_is_asked_for(spark):
    from tillkit.plans.catalog import PLANS
    import tillkit.plans.sql  # noqa: F401 - registers all plans

    assert "dynamicpruning" in plan_text(PLANS["F1_products_of_live_bakeries"](spark, SF))
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # off: the plan text shows the buckets that are read
    spark.conf.set(auto, "false")
    try:
        buckets = plan_text(PLANS["F11_stored_look_up"](spark, SF)).split("SelectedBucketsCount: ")[1]
    finally:
        spark.conf.unset(auto)
    assert int(buckets.split(" out of ")[0]) <= 4 and buckets.split(" out of ")[1].startswith("32")


def test_functions_per_row_are_joins(spark):
    from tillkit.plans.catalog import PLANS
    import tillkit.plans.sql  # noqa: F401 - registers all plans

    for name in ("R1_summary_per_row", "R2_daily_per_row", "R3_top_products_per_row", "R4_methods_per_row"):
        text = plan_text(PLANS[name](spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text and "Join" in text


def test_full_product_table(spark):
    from tillkit.sources import products

    short = spark.createDataFrame([(1, 2, "a", D("3.00"))], "id long, tenant_id int, name string, price decimal(12,2)")
    row = products.full(short).first()
    assert len(row) == 29 and row.variants == "{}" and row.discount_type == "percent" and row.tax_percent == 0 and row.is_active
    new = spark.createDataFrame([(2, "b", D("1.00"))], "tenant_id int, name string, price decimal(12,2)")
    made = products.create(products.full(short), new, ["name"], "2024-01-01 00:00:00").filter("id = 2").first()
    assert made.variants == "{}" and made.discount_type is None and made.tax_percent is None and made.is_active
