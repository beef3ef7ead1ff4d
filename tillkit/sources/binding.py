"""Binding of the driver's parquet tables to the billing tables.

The same expressions are written in DuckDB SQL in ``tillkit.plans.oracle``;
both sides cast double to decimal first. Every bound table is derived from a
given table, so its size grows with the data:

=======================  ====================================================
billing table            from
=======================  ====================================================
tenants                  nation (id, name); business type by ``key % 5``
customers                customer; live when ``c_acctbal >= 0``
products                 part; ``tenant_id = p_partkey % 25``
invoices (headers)       orders; ``tenant_id = o_custkey % 25``
invoice lines / items    lineitem; unit price is ``l_extendedprice``
users                    customer; role by ``c_custkey % 3 + 1``
tenant_roles             supplier (one custom role per supplier)
tenant_role_permissions  supplier joined to a grant template by ``key % 3``
tenant_features          tenants joined to the features of their type
audit events             events
=======================  ====================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillkit.functions.money import ITEM_PRICE, ITEM_QTY, MONEY, PRICE, QTY, RATE
from tillkit.sources import seeds
from tillkit.sources.schemas import ITEM
from tillkit.sources.tables import read_table

# FIXED VALUES of the binding (shared with the oracle SQL).
TENANT_COUNT = 25                      # nation rows at every scale factor
INACTIVE_TENANT_MOD, INACTIVE_TENANT_REM = 7, 6
THEME_COLOR = "#0EA5E9"
USER_EPOCH = "2020-01-01"
USER_DAYS = 1000


def tenants(spark: SparkSession, base: str) -> DataFrame:
    n = read_table(spark, base, "nation")
    kinds = F.array(*[F.lit(b) for b in seeds.BUSINESS_TYPES_V1])
    return n.select(
        F.col("n_nationkey").cast("int").alias("id"),
        F.col("n_name").alias("name"),
        F.element_at(kinds, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("business_type"),
        F.lit(None).cast("int").alias("business_type_id"),
        (F.col("n_nationkey") % INACTIVE_TENANT_MOD != INACTIVE_TENANT_REM).alias("is_active"),
        F.when(F.col("n_regionkey") == 0, F.lit(None).cast("string"))
         .when(F.col("n_regionkey") == 1, F.lit(""))
         .otherwise(F.lit(THEME_COLOR)).alias("theme_color"),
    )


def customers(spark: SparkSession, base: str) -> DataFrame:
    c = read_table(spark, base, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").cast("int").alias("tenant_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def products(spark: SparkSession, base: str) -> DataFrame:
    p = read_table(spark, base, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        (F.col("p_partkey") % TENANT_COUNT).cast("int").alias("tenant_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast(PRICE).alias("price"),
        (F.col("p_size") * 100).cast(QTY).alias("stock_qty"),
        (F.col("p_size") % 10 != 0).alias("is_active"),
    )


def invoice_lines(spark: SparkSession, base: str) -> DataFrame:
    """Flat invoice lines: one per lineitem, which carries its own price."""
    li = read_table(spark, base, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast(ITEM_QTY).alias("quantity"),
        F.col("l_extendedprice").cast(ITEM_PRICE).alias("unit_price"),
        (F.col("l_discount").cast("decimal(5,2)") * 100).cast(ITEM_PRICE).alias("discount"),
        F.lit("percent").alias("discount_type"),
        (F.col("l_tax").cast("decimal(5,2)") * 100).cast(RATE).alias("tax_percent"),
    )


def _payment_method(priority: F.Column) -> F.Column:
    first = F.substring(priority, 1, 1)
    return (F.when(first.isin("1", "2"), "cash")
             .when(first == "3", "upi")
             .when(first == "4", "card")
             .when(first == "5", "split"))  # the billing form offers it, the table's check does not


def invoice_headers(spark: SparkSession, base: str, variant: bool = True) -> DataFrame:
    """One invoice request per order, with a tenant of its own.

    ``variant`` sets bill discount and paid amount to ``o_orderkey % 7``
    (both 0 otherwise).
    """
    o = read_table(spark, base, "orders")
    amount = (F.col("o_orderkey") % 7) if variant else F.lit(0)
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("request_id"),
        (F.col("o_custkey") % TENANT_COUNT).cast("int").alias("tenant_id"),
        F.lit(None).cast("long").alias("user_id"),
        F.col("o_custkey").alias("customer_id"),
        _payment_method(F.col("o_orderpriority")).alias("payment_method"),
        F.when(status == "F", "paid").when(status == "O", "pending")
         .when(status == "P", "cancelled").alias("payment_status"),
        F.when(status == "F", "Paid").when(status == "O", "Draft")
         .when(status == "P", "Cancelled").alias("invoice_status"),
        amount.cast(MONEY).alias("paid_amount"),
        F.to_json(F.struct(amount.cast("int").alias("bill_discount"))).alias("metadata"),
        F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("long").alias("table_id"),
        F.lit(None).cast("long").alias("kot_id"),
        F.col("o_orderdate").alias("created_at"),
    )


def invoice_keys(spark: SparkSession, base: str) -> DataFrame:
    """Invoice id and time straight from the order scan (for key restriction)."""
    return read_table(spark, base, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("created_at"))


def invoice_requests(spark: SparkSession, base: str, variant: bool = True) -> DataFrame:
    """Nested form: headers with an ``items`` array (the reference's JSONB column).

    Lines are ordered by line number, then by all item columns. Building the
    arrays needs one shuffle of lineitem by order key; pricing the nested form
    afterwards is shuffle-free.
    """
    lines = invoice_lines(spark, base)
    names = [f.name for f in ITEM.fields]
    grouped = lines.groupBy("invoice_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", *names))).alias("_lines"))
    items = grouped.select(
        "invoice_id",
        F.transform("_lines", lambda x: F.struct(*[x[n].alias(n) for n in names])).alias("items"))
    hdr = invoice_headers(spark, base, variant)
    out = hdr.join(items, hdr.request_id == items.invoice_id, "left")
    empty = F.array().cast(T.ArrayType(ITEM))
    return out.withColumn("items", F.coalesce("items", empty)).drop("invoice_id")


def users(spark: SparkSession, base: str) -> DataFrame:
    c = read_table(spark, base, "customer")
    role = (F.col("c_custkey") % 3 + 1).cast("int")
    # custom roles are spread over all tenant roles (suppliers)
    roles = read_table(spark, base, "supplier").select(F.max("s_suppkey") + 1).scalar()
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.col("c_name").alias("full_name"),
        role.alias("role_id"),
        F.when(role == 1, F.lit(None).cast("int"))
         .otherwise(F.col("c_nationkey").cast("int")).alias("tenant_id"),
        F.when((role == 3) & (F.col("c_custkey") % 2 == 0),
               F.col("c_custkey") % roles).alias("tenant_role_id"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.date_add(F.lit(USER_EPOCH).cast("date"),
                   (F.col("c_custkey") % USER_DAYS).cast("int")).alias("created_at"),
    )


def tenant_roles(spark: SparkSession, base: str) -> DataFrame:
    s = read_table(spark, base, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_nationkey").cast("int").alias("tenant_id"),
        F.col("s_name").alias("name"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
    )


def tenant_role_permissions(spark: SparkSession, base: str) -> DataFrame:
    """Each custom role gets the grants of template ``s_suppkey % 3 + 1``,
    without the super-admin-only menus."""
    s = read_table(spark, base, "supplier").select(
        F.col("s_suppkey").alias("tenant_role_id"),
        (F.col("s_suppkey") % 3 + 1).cast("int").alias("template_id"))
    excluded = [m[0] for m in seeds.MENUS if m[2] in seeds.SUPER_ADMIN_ONLY_ROUTES]
    grants = seeds.role_grants(spark).filter(~F.col("menu_id").isin(excluded))
    j = s.join(F.broadcast(grants), s.template_id == grants.role_id, "inner")
    return j.select("tenant_role_id", "menu_id", *seeds.PERMISSION_FIELDS)


def tenant_features(spark: SparkSession, base: str) -> DataFrame:
    t = tenants(spark, base)
    f = seeds.features_by_business_type(spark)
    j = t.join(F.broadcast(f), t.business_type == f.business_type, "inner")
    return j.select(F.col("id").alias("tenant_id"), "feature_key", "enabled")


def audit_events(spark: SparkSession, base: str) -> DataFrame:
    e = read_table(spark, base, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.col("event_type").alias("action"),
        F.col("value"),
        F.col("ts").alias("created_at"),
    )
