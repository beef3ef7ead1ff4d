"""Registered query plans: name -> (spark, sf_dir) -> DataFrame.

Each plan reads the driver's parquet tables through the binding and runs one
operator of the inventory over the whole tables. The matching DuckDB SQL is
in ``tillkit.plans.sql``.
"""

from __future__ import annotations

from collections.abc import Callable
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillkit.functions import predicates as P
from tillkit.functions.money import PRICE
from tillkit.operators import aggregates, access, listing, maintenance, pricing, quality, reports
from tillkit.operators.numbering import assign_ids
from tillkit.sources import binding as B
from tillkit.sources import seeds
from tillkit.sources.tables import read_table
from tillkit.session import ensure_checkpoint_dir
from tillkit.streaming import sales

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}

# Report parameters used by the filtered forms (F3, F4 with N8).
RANGE_START, RANGE_END = "1996-01-01", "1997-12-31"


def plan(name: str):
    def deco(fn: Plan) -> Plan:
        PLANS[name] = fn
        return fn
    return deco


def priced(spark: SparkSession, d: str, version: str = "v3", start=None, end=None) -> DataFrame:
    """The invoices table: every bound order priced from its lines.

    With a date range the headers are filtered first and only the lines of
    the orders in range are priced (``restrict_to``).
    """
    hdr = B.invoice_headers(spark, d)
    keys = None
    if start is not None or end is not None:
        hdr = hdr.filter(P.created_between(start, end))
        keys = B.invoice_keys(spark, d).filter(P.created_between(start, end)).select("request_id")
    return pricing.price_invoice_lines(hdr, B.invoice_lines(spark, d), version, restrict_to=keys)


# ------------------------------------------------------------------ pricing

def _invoice_scope(spark, d):
    """Invoice id, tenant, time, customer and status, without pricing: what
    plans need that do not use the totals (top products, the settle requests),
    so lineitem is not scanned for them."""
    return B.invoice_headers(spark, d).withColumnRenamed("request_id", "id")


_PRICED_COLS = ["id", "tenant_id", "customer_id", "subtotal", "discount_total", "tax_total",
                "grand_total", "payment_method", "payment_status", "created_at"]


@plan("B1_price_invoices_v3")
def b1_v3(spark, d):
    return priced(spark, d, "v3").select(*_PRICED_COLS, "paid_amount", "balance",
                                         "invoice_status", "bill_discount")


@plan("B1b_price_invoices_v2")
def b1_v2(spark, d):
    return priced(spark, d, "v2").select(*_PRICED_COLS, "paid_amount", "balance",
                                         "invoice_status")


@plan("B1a_price_invoices_v1")
def b1_v1(spark, d):
    return priced(spark, d, "v1").select(*_PRICED_COLS)


@plan("B2_invoice_numbers")
def b2(spark, d):
    hdr = B.invoice_headers(spark, d).select(F.col("request_id").alias("id"), "tenant_id",
                                             "created_at")
    return pricing.number_invoices(hdr)


@plan("W2_surrogate_keys")
def w2(spark, d):
    """Ids for every order posted as a new invoice, after the current max
    key, in (time, key) order -- a global sequence without a single-task window."""
    orders = read_table(spark, d, "orders")
    rows = orders.select(F.col("o_orderkey").alias("request_id"),
                         F.col("o_orderdate").alias("created_at"))
    return assign_ids(rows, ["created_at", "request_id"],
                      start_after=orders.select("o_orderkey"))


@plan("B3_stock_after_sales")
def b3(spark, d):
    hdr = B.invoice_headers(spark, d).select("request_id", "tenant_id")
    lines = B.invoice_lines(spark, d)
    sold = lines.join(hdr, lines["invoice_id"] == hdr["request_id"], "inner")
    return pricing.deduct_stock(B.products(spark, d), sold).select("id", "tenant_id", "name",
                                                                   "stock_qty")


@plan("B4_settle_drafts")
def b4(spark, d):
    inv = priced(spark, d, "v3")
    # the settle requests: every draft invoice of its own tenant
    drafts = _invoice_scope(spark, d).filter(F.col("invoice_status") == "Draft").select(
        "id", "tenant_id")
    return pricing.settle_invoices(inv, drafts).select(
        "id", "tenant_id", "grand_total", "paid_amount", "balance", "invoice_status")


# ------------------------------------------------------------------ reports

@plan("R1_sales_summary")
def r1(spark, d):
    return reports.sales_summary(priced(spark, d), tenants=B.tenants(spark, d))


@plan("R1_sales_summary_range")
def r1_range(spark, d):
    inv = priced(spark, d, start=RANGE_START, end=RANGE_END)
    return reports.sales_summary(inv, start=RANGE_START, end=RANGE_END,
                                 tenants=B.tenants(spark, d))


@plan("R1a_sales_summary_v1")
def r1a(spark, d):
    return reports.sales_summary_v1(priced(spark, d))


@plan("R2_daily_sales")
def r2(spark, d):
    return reports.daily_sales(priced(spark, d))


@plan("R2_daily_sales_range")
def r2_range(spark, d):
    inv = priced(spark, d, start=RANGE_START, end=RANGE_END)
    return reports.daily_sales(inv, start=RANGE_START, end=RANGE_END)


@plan("R2a_daily_sales_v1")
def r2a(spark, d):
    return reports.daily_sales_v1(priced(spark, d))


@plan("R3_top_products")
def r3(spark, d):
    return reports.top_products(_invoice_scope(spark, d), B.invoice_lines(spark, d),
                                B.products(spark, d))


@plan("R3a_top_products_v1")
def r3a(spark, d):
    return reports.top_products_v1(_invoice_scope(spark, d), B.invoice_lines(spark, d),
                                   B.products(spark, d))


@plan("R4_payment_methods")
def r4(spark, d):
    return reports.payment_methods(priced(spark, d))


@plan("R4a_payment_methods_v1")
def r4a(spark, d):
    return reports.payment_methods_v1(priced(spark, d))


# ------------------------------------------------------------ listings, access

@plan("L2_list_products")
def l2(spark, d):
    return listing.list_products(B.products(spark, d))


@plan("L3_list_customers")
def l3(spark, d):
    return listing.list_customers(B.customers(spark, d))


@plan("L4_list_invoices")
def l4(spark, d):
    return listing.list_invoices(priced(spark, d)).select(
        "id", "tenant_id", "customer_id", "grand_total", "invoice_status", "created_at")


@plan("L10_list_tenant_roles")
def l10(spark, d):
    return listing.list_tenant_roles(B.tenant_roles(spark, d))


@plan("J1_login_rows")
def j1(spark, d):
    return access.login_rows(B.users(spark, d), seeds.roles(spark))


@plan("J2_list_users_admin_view")
def j2_admin(spark, d):
    return access.list_users(B.users(spark, d), seeds.roles(spark), B.tenant_roles(spark, d),
                             B.tenants(spark, d), viewer_role_id=1)


@plan("J2_list_staff_all_tenants")
def j2_staff(spark, d):
    return access.list_users(B.users(spark, d), seeds.roles(spark), B.tenant_roles(spark, d),
                             B.tenants(spark, d), viewer_role_id=2, all_tenants=True)


@plan("J3_user_menus")
def j3(spark, d):
    return access.user_menus(B.users(spark, d), seeds.menus(spark), seeds.role_grants(spark),
                             B.tenant_role_permissions(spark, d))


@plan("J8_user_business_type")
def j8(spark, d):
    bt = seeds.business_types(spark)
    tbt = access.tenant_business_type(access.link_business_types(B.tenants(spark, d), bt), bt)
    u = B.users(spark, d).select(F.col("id").alias("user_id"), "tenant_id")
    return u.join(tbt, "tenant_id", "left").select(
        "user_id", "tenant_id", "business_type_id", "business_type_name", "business_type_label")


@plan("J11_staff_roles_of_own_tenant")
def j11(spark, d):
    u = B.users(spark, d).filter(F.col("tenant_role_id").isNotNull()).select(
        F.col("id").alias("user_id"), F.col("tenant_role_id").alias("id"), "tenant_id")
    return access.owned_by_tenant(u, B.tenant_roles(spark, d))


@plan("J13_tenant_role_permission_listing")
def j13(spark, d):
    trp = B.tenant_role_permissions(spark, d).withColumnRenamed("tenant_role_id", "role_id")
    return access.permission_listing(trp, B.tenant_roles(spark, d), seeds.menus(spark))


@plan("F14_user_branding")
def f14(spark, d):
    return access.user_branding(B.users(spark, d), B.tenants(spark, d))


@plan("S5_menu_access_log")
def s5(spark, d):
    req = B.users(spark, d).select(F.col("id").alias("user_id"), "tenant_id")
    return access.menu_access_log(req)


@plan("A12_active_users_per_tenant_role")
def a12(spark, d):
    return access.active_users_per_tenant_role(B.users(spark, d))


# ----------------------------------------------------------------- maintenance
#
# Each maintenance plan builds a table of change requests from the given
# tables (e.g. "rename the roles of suppliers with a negative balance") and
# returns the *whole* resulting table, so the predicates below select which
# rows a request touches, never which rows are returned.

def _supplier(spark, d):
    return read_table(spark, d, "supplier")


@plan("M1_patch_products")
def m1(spark, d):
    part = read_table(spark, d, "part")
    changes = part.select(
        F.col("p_partkey").alias("id"),
        (F.col("p_partkey") % B.TENANT_COUNT).cast("int").alias("tenant_id"),
        F.when(F.col("p_size") < 5, F.upper("p_name")).alias("name"),
        F.when(F.col("p_size") > 25,
               (F.col("p_retailprice").cast(PRICE) * F.lit(Decimal("1.1"))).cast(PRICE)
               ).alias("price"))
    return maintenance.patch(B.products(spark, d), changes, ["id", "tenant_id"])


def _flag_rows(src, menu_id: int, flags):
    return src.select(F.col("s_suppkey").alias("tenant_role_id"),
                      F.lit(menu_id).cast("int").alias("menu_id"),
                      *[(f if isinstance(f, F.Column) else F.lit(f)).alias(c)
                        for c, f in zip(seeds.PERMISSION_FIELDS, flags)])


@plan("M2_upsert_tenant_role_permissions")
def m2(spark, d):
    s = _supplier(spark, d)
    changes = _flag_rows(s, 5, [F.col("s_acctbal") > 0, False, False, False]).unionByName(
        _flag_rows(s, 1, [True, True, True, True]))
    return maintenance.upsert(B.tenant_role_permissions(spark, d), changes,
                              ["tenant_role_id", "menu_id"])


@plan("M3_insert_ignore_grants")
def m3(spark, d):
    s = _supplier(spark, d)
    rows = (_flag_rows(s, 1, [False] * 4).withColumn("pos", F.lit(1))
            .unionByName(_flag_rows(s, 7, [True, False, False, False]).withColumn("pos", F.lit(1)))
            .unionByName(_flag_rows(s, 7, [True] * 4).withColumn("pos", F.lit(2))))
    return maintenance.insert_ignore(B.tenant_role_permissions(spark, d), rows,
                                     ["tenant_role_id", "menu_id"], order=["pos"])


@plan("M4_save_tenant_roles")
def m4(spark, d):
    s = _supplier(spark, d)
    upd = s.filter(F.col("s_acctbal") < 0).select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("int").alias("tenant_id"),
        F.upper("s_name").alias("name"))
    ins = s.filter(F.col("s_acctbal") > 9000).select(
        F.lit(0).cast("long").alias("id"), F.col("s_nationkey").cast("int").alias("tenant_id"),
        F.concat(F.col("s_name"), F.lit(" Senior")).alias("name"))
    return maintenance.save_by_id(B.tenant_roles(spark, d), upd.unionByName(ins), ["name"],
                                  tenant_id_col="tenant_id", order=["tenant_id", "name"],
                                  defaults={"is_active": True})


@plan("M5_insert_products_with_defaults")
def m5(spark, d):
    part = read_table(spark, d, "part")
    rows = part.select(
        F.col("p_partkey").alias("src"),
        ((F.col("p_partkey") + 1) % B.TENANT_COUNT).cast("int").alias("tenant_id"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast(PRICE).alias("price"))
    return maintenance.insert_with_defaults(
        B.products(spark, d), rows, {"category": "General", "stock_qty": 0, "is_active": True},
        order=["src"])


@plan("M6_soft_delete_unsold_products")
def m6(spark, d):
    p = B.products(spark, d)
    # one row per product before the join: a hot product is one row per map task
    sold = read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    unsold = p.select("id").join(sold, "id", "left_anti")
    return maintenance.soft_delete(p, unsold, ["id"]).select("id", "tenant_id", "is_active")


@plan("M9_cascade_deactivate_users")
def m9(spark, d):
    ids = read_table(spark, d, "nation").filter(F.col("n_regionkey") == 4).select(
        F.col("n_nationkey").cast("int").alias("id"))
    _, users = maintenance.cascade_deactivate(B.tenants(spark, d), B.users(spark, d), ids)
    return users.select("id", "tenant_id", "is_active")


@plan("M10_toggle_users")
def m10(spark, d):
    c = read_table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    u = B.users(spark, d)
    req = u.join(c.select(F.col("c_custkey").alias("id")), "id", "left_semi").select(
        "id", "tenant_id")
    return maintenance.toggle_active(u, req).select("id", "tenant_id", "is_active")


@plan("M11_delete_inactive_users")
def m11(spark, d):
    u = B.users(spark, d)
    gone = u.filter(~F.col("is_active")).select("id")
    return maintenance.hard_delete(u, gone, ["id"]).select("id", "tenant_id", "role_id")


@plan("M12_replace_role_permissions")
def m12(spark, d):
    owners = _supplier(spark, d).filter(F.col("s_acctbal") < 0)
    menus = F.array(*[F.lit(m).cast("int") for m in (1, 2, 8, 9)])
    new = owners.select(F.col("s_suppkey").alias("tenant_role_id"),
                        F.explode(menus).alias("menu_id"),
                        F.lit(True).alias("can_view"), F.lit(True).alias("can_add"),
                        F.lit(False).alias("can_edit"), F.lit(False).alias("can_delete"))
    return maintenance.replace_sets(
        B.tenant_role_permissions(spark, d), "tenant_role_id",
        owners.select(F.col("s_suppkey").alias("tenant_role_id")), new)


@plan("M14_update_billing_grants")
def m14(spark, d):
    return maintenance.update_where(B.tenant_role_permissions(spark, d),
                                    F.col("menu_id").isin(2, 8, 9),
                                    {"can_edit": False, "can_delete": False})


@plan("M15_products_with_new_columns")
def m15(spark, d):
    p = B.products(spark, d)
    p = maintenance.add_column(p, "discount", 0, "decimal(12,2)")
    p = maintenance.add_column(p, "discount_type", "percent", "string")
    p = maintenance.add_column(p, "tax_percent", 0, "decimal(5,2)")
    return maintenance.add_column(p, "variants", "{}", "string")


# --------------------------------------------------------- quality, aggregates

def _headers_as_invoices(spark, d):
    return B.invoice_headers(spark, d).withColumnRenamed("request_id", "id")


@plan("E2_invalid_payment_method")
def e2(spark, d):
    return quality.check_allowed(_headers_as_invoices(spark, d), "invoices", "payment_method",
                                 seeds.PAYMENT_METHODS, ["id"])


@plan("E5_duplicate_invoice_lines")
def e5(spark, d):
    return quality.check_unique(B.invoice_lines(spark, d), "invoice_lines",
                                ["invoice_id", "line_no"])


@plan("E6_orphan_line_products")
def e6(spark, d):
    return quality.check_foreign_key(B.invoice_lines(spark, d), "invoice_lines", ["product_id"],
                                     B.products(spark, d), ["id"], ["invoice_id", "line_no"])


@plan("E7_missing_product_price")
def e7(spark, d):
    return quality.check_not_null(B.products(spark, d), "products", "price", ["id"])


@plan("E_quality_summary")
def e_summary(spark, d):
    """E1-E7 counts with one scan per table: the line rules ride on a single
    grouping by line key, the header rules are conditional counts of one scan."""
    inv = quality.orphan_flag(_headers_as_invoices(spark, d), "customer_id",
                              B.customers(spark, d), "id")
    header_counts = quality.violation_counts(inv, "invoices", [
        ("check:payment_method", F.count_if(F.col("payment_method").isNotNull()
                                            & ~F.col("payment_method").isin(seeds.PAYMENT_METHODS))),
        ("check:payment_status", F.count_if(F.col("payment_status").isNotNull()
                                            & ~F.col("payment_status").isin(seeds.PAYMENT_STATUSES))),
        ("fk:customer_id", F.count_if(F.col("_orphan"))),
        ("not_null:tenant_id", F.count_if(F.col("tenant_id").isNull())),
    ])
    lines = quality.orphan_flag(B.invoice_lines(spark, d), "product_id", B.products(spark, d), "id")
    per_key = lines.groupBy("invoice_id", "line_no").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_orphan")).alias("_o"))
    line_counts = quality.violation_counts(per_key, "invoice_lines", [
        ("unique:invoice_id,line_no", F.count_if(F.col("invoice_id").isNotNull()
                                                 & F.col("line_no").isNotNull() & (F.col("_n") > 1))),
        ("fk:product_id", F.sum("_o")),
    ])
    return header_counts.unionByName(line_counts)


@plan("A10_products_per_business_type")
def a10(spark, d):
    t = B.tenants(spark, d).select("id", F.col("business_type").alias("label"))
    return aggregates.count_by_label(B.products(spark, d), t, "tenant_id")


@plan("A11_rows_per_tenant")
def a11(spark, d):
    return aggregates.rows_per_tenant({
        "customers": B.customers(spark, d), "products": B.products(spark, d),
        "invoices": B.invoice_headers(spark, d)})


@plan("A13_duplicate_product_names")
def a13(spark, d):
    return aggregates.duplicates_keep_least(B.products(spark, d), "name")


# ------------------------------------------------------------------ streaming

@plan("T1_daily_sales_stream")
def t1(spark, d):
    """T1 end to end: the priced invoices replayed as a file stream into the
    streaming daily-sales aggregation; returns what the sink holds."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillkit-t1-{uuid.uuid4().hex}"
    inv = priced(spark, d).select("id", "tenant_id", "grand_total", "created_at")
    return sales.replay_daily_sales(inv, root)


@plan("T2_invoice_posting_stream")
def t2(spark, d):
    """T2 end to end: nested invoice requests replayed as a file stream, each
    micro-batch priced from its own items in ``foreachBatch`` (no join).

    A file is a task, so a micro-batch takes as many files as there are cores."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillkit-t2-{uuid.uuid4().hex}"
    posted = sales.replay_invoice_posting(B.invoice_requests(spark, d), root,
                                          files_per_batch=max(2, spark.sparkContext.defaultParallelism))
    return posted.select(*_PRICED_COLS, "paid_amount", "balance", "invoice_status",
                         "bill_discount")
