"""Registered plans over stored tables: posting, ledger, streams, partial rewrites, variants, orders.

Importing this module adds to ``catalog.PLANS``; ``SQL`` has the DuckDB form of
each. Folders lie under the shared checkpoint folder, one per run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillkit.functions.ordering import nulls_first, pg_asc, pg_desc
from tillkit.functions import predicates as P
from tillkit.operators import access, listing, maintenance, reports
from tillkit.operators.numbering import with_position
from tillkit.plans import posting, sql_functions
from tillkit.plans.catalog import plan, priced
from tillkit.plans.oracle import priced_ctes, with_ctes
from tillkit.session import ensure_checkpoint_dir
from tillkit.sources import binding as B
from tillkit.sources import seeds, variants
from tillkit.sources.buckets import BucketTable
from tillkit.sources.tables import append_partitioned, read_table, write_bucketed
from tillkit.streaming import sales

SQL: dict[str, str] = {}
_PRICED_V3 = with_ctes(*priced_ctes("v3"))


def run_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillkit-{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------ posting, ledger

def _posted(spark, d) -> str:
    """Orders posted in three batches by date; the second one then again without its cancelled ones."""
    path = run_folder(spark, "posting")
    year = F.year("created_at")
    batch = F.when(year < 1994, 1).when(year.isin(1994, 1995), 2).when(year > 1995, 3)
    # the requests are kept once, each batch in a folder of its own: lines are not grouped again per batch
    kept = f"{path}-requests"
    requests = B.invoice_requests(spark, d).withColumn("batch", batch).where("batch is not null")
    requests = posting.keep_requests(requests, kept, "batch", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    batches = {n: requests.where(F.col("batch") == n).drop("batch") for n in (1, 2, 3)}
    for n, asked in batches.items():
        posting.post_invoices(spark, asked, path, n)
    posting.post_invoices(spark, batches[2].where(F.col("invoice_status") != "Cancelled"), path, 2)
    posting.drop_requests(spark, kept)
    return path


@plan("Posting_batches")
def posting_batches(spark, d):
    """Path 2 over all orders: ids, numbers and totals after a rerun that shrank a batch."""
    return spark.read.parquet(_posted(spark, d)).select(
        "id", "request_id", "tenant_id", "invoice_number", "grand_total", "balance",
        F.col("batch_id").cast("int").alias("batch_id"))


_BATCH = "CASE WHEN year(created_at) < 1994 THEN 1 WHEN year(created_at) < 1996 THEN 2 ELSE 3 END"
SQL["Posting_batches"] = _PRICED_V3 + f""", posted AS (
  SELECT id AS request_id, tenant_id, grand_total, balance, invoice_status, {_BATCH} AS batch_id,
         row_number() OVER (ORDER BY {_BATCH}, created_at, id) AS id,
         'INV-' || tenant_id || '-' || strftime(created_at, '%Y%m%d') || '-' || lpad(CAST(row_number() OVER (
           PARTITION BY tenant_id, CAST(created_at AS DATE) ORDER BY created_at, id) AS VARCHAR), 4, '0') AS invoice_number
  FROM priced)
SELECT id, request_id, tenant_id, invoice_number, grand_total, balance, batch_id FROM posted
WHERE NOT (batch_id = 2 AND invoice_status = 'Cancelled')"""


@plan("B3_stock_ledger")
def b3_ledger(spark, d):
    """B3 from the ledger that the same batches kept."""
    return posting.stock_snapshot(spark, B.products(spark, d), _posted(spark, d)).select(
        "id", "tenant_id", "name", "stock_qty")


SQL["B3_stock_ledger"] = with_ctes("products", "lines", "headers") + f""", sold AS (
  SELECT h.tenant_id, l.product_id, SUM(l.quantity) AS sold
  FROM lines l JOIN headers h ON h.request_id = l.invoice_id
  WHERE NOT ({_BATCH} = 2 AND invoice_status = 'Cancelled') GROUP BY h.tenant_id, l.product_id)
SELECT p.id, p.tenant_id, p.name, CAST(p.stock_qty - COALESCE(s.sold, 0) AS DECIMAL(12,3)) AS stock_qty
FROM products p LEFT JOIN sold s ON s.tenant_id = p.tenant_id AND s.product_id = p.id"""


# ------------------------------------------------------------ streams

#: Orders of this priority come in ten days after their time.
LATE, LATE_DAYS = "1-URGENT", 10


@plan("T1_finished_days_stream")
def t1_append(spark, d):
    """T1 with a watermark of 2 days: priced invoices arrive by half-year, urgent ones 10 days late."""
    late = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == LATE).alias("late"))
    inv = priced(spark, d).select("id", "tenant_id", "grand_total", "created_at").join(late, "id")
    came = F.date_add(F.to_date("created_at"), F.when(F.col("late"), LATE_DAYS).otherwise(0))
    slices = inv.withColumn("slice", F.year(came) * 2 + (F.month(came) > 6).cast("int")).drop("late")
    root = run_folder(spark, "t1-append")
    sales.arrive(slices, "slice", root, sales.append_daily_sales)
    return spark.read.parquet(f"{root}/sink")


SQL["T1_finished_days_stream"] = _PRICED_V3 + f""", came AS (
  SELECT p.*, CAST(p.created_at AS DATE) + CASE WHEN o.o_orderpriority = '{LATE}' THEN {LATE_DAYS} ELSE 0 END AS came
  FROM priced p JOIN orders o ON o.o_orderkey = p.id),
sliced AS (SELECT *, year(came) * 2 + CASE WHEN month(came) > 6 THEN 1 ELSE 0 END AS slice FROM came),
marks AS (SELECT slice, max(max(created_at)) OVER (ORDER BY slice) - INTERVAL 2 DAY AS mark FROM sliced GROUP BY slice),
taken AS (
  SELECT s.* FROM sliced s ASOF LEFT JOIN marks m ON s.slice > m.slice
  WHERE m.mark IS NULL OR CAST(CAST(s.created_at AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) > m.mark)
SELECT tenant_id, CAST(created_at AS DATE) AS sale_date, CAST(SUM(grand_total) AS DECIMAL(38,2)) AS total_revenue,
       COUNT(id) AS total_invoices
FROM taken
WHERE CAST(CAST(created_at AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT max(mark) FROM marks)
GROUP BY ALL"""


@plan("B2_numbers_stream")
def b2_stream(spark, d):
    """B2 as a stream: orders in time order, in slices that cut through days."""
    hdr = B.invoice_headers(spark, d).select(F.col("request_id").alias("id"), "tenant_id", "created_at")
    slices = hdr.repartitionByRange(5, "created_at", "id").withColumn("slice", F.spark_partition_id())
    root = run_folder(spark, "b2-stream")
    sales.arrive(slices, "slice", root, sales.start_numbering)
    return spark.read.parquet(f"{root}/sink")


SQL["B2_numbers_stream"] = with_ctes("headers") + """
SELECT request_id AS id, tenant_id, created_at,
       'INV-' || tenant_id || '-' || strftime(created_at, '%Y%m%d') || '-' || lpad(CAST(row_number() OVER (
         PARTITION BY tenant_id, CAST(created_at AS DATE) ORDER BY created_at, request_id) AS VARCHAR), 4, '0')
         AS invoice_number
FROM headers"""


# ------------------------------------------------------------ partial rewrites

BUCKETS = 64


def _bucketed(spark, rows: DataFrame, keys: list[str], name: str) -> BucketTable:
    table = BucketTable(spark, run_folder(spark, name), keys, BUCKETS)
    table.create(rows)
    return table


@plan("M1_patch_stored_products")
def m1_stored(spark, d):
    """M1 on the stored table: the price of one brand's smallest parts goes up."""
    table = _bucketed(spark, B.products(spark, d), ["id"], "m1")
    part = read_table(spark, d, "part").where("p_brand = 'Brand#11' and p_size <= 5")
    changes = part.select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"),
                          (F.col("p_retailprice").cast("decimal(12,2)") + 1).cast("decimal(12,2)").alias("price"))
    table.change(changes, lambda rows, ch: maintenance.patch(rows, ch, ["id"]))
    return table.read()


SQL["M1_patch_stored_products"] = with_ctes("products") + """
SELECT p.id, tenant_id, CASE WHEN p_partkey IS NOT NULL THEN upper(name) ELSE name END AS name, category, brand,
       CAST(CASE WHEN p_partkey IS NOT NULL THEN price + 1 ELSE price END AS DECIMAL(12,2)) AS price, stock_qty, is_active
FROM products p LEFT JOIN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_size <= 5) c ON c.p_partkey = p.id"""


@plan("M2_upsert_stored_permissions")
def m2_stored(spark, d):
    """M2 on the stored table: roles of the poorest suppliers get menu 5 and lose the rest of menu 1."""
    table = _bucketed(spark, B.tenant_role_permissions(spark, d), ["tenant_role_id"], "m2")
    poor = read_table(spark, d, "supplier").where("s_acctbal < -500")
    menu = F.explode(F.array(F.lit(1), F.lit(5))).alias("menu_id")
    changes = poor.select(F.col("s_suppkey").alias("tenant_role_id"), menu).select(
        "*", F.lit(True).alias("can_view"), *[F.lit(False).alias(c) for c in ("can_add", "can_edit", "can_delete")])
    table.change(changes, lambda rows, ch: maintenance.upsert(rows, ch, ["tenant_role_id", "menu_id"]))
    return table.read()


SQL["M2_upsert_stored_permissions"] = with_ctes("role_permissions", "tenant_role_permissions") + """
, changes AS (
  SELECT s_suppkey AS tenant_role_id, CAST(m AS INTEGER) AS menu_id, TRUE AS can_view, FALSE AS can_add,
         FALSE AS can_edit, FALSE AS can_delete
  FROM supplier, (VALUES (1), (5)) t(m) WHERE s_acctbal < -500)
SELECT * FROM changes
UNION ALL
SELECT p.* FROM tenant_role_permissions p ANTI JOIN changes USING (tenant_role_id, menu_id)"""


@plan("M10_toggle_stored_users")
def m10_stored(spark, d):
    """M10 on the stored table: users of one segment with a very low balance are toggled."""
    table = _bucketed(spark, B.users(spark, d), ["id"], "m10")
    low = read_table(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal < -900")
    asked = low.select(F.col("c_custkey").alias("id"), F.lit(None).cast("int").alias("tenant_id"))
    table.change(asked, maintenance.toggle_active)
    return table.read().select("id", "tenant_id", "is_active")


SQL["M10_toggle_stored_users"] = with_ctes("users") + """
SELECT u.id, u.tenant_id, CASE WHEN c.c_custkey IS NOT NULL THEN NOT u.is_active ELSE u.is_active END AS is_active
FROM users u LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < -900) c
  ON c.c_custkey = u.id"""


# ------------------------------------------------------------ free-form JSON

@plan("S3_product_variants")
def s3_variants(spark, d):
    """Variants and attributes as JSON objects, stored as VARIANT and read by path."""
    part = read_table(spark, d, "part")
    given = part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") % 10 != 0, variants.encode(
            sizes=F.array(F.col("p_size"), F.col("p_size") + 1), container=F.col("p_type"))).alias("variants"),
        variants.encode(type=F.col("p_name"), maker=F.struct(F.col("p_brand").alias("brand"))).alias("attributes"))
    path = f"{run_folder(spark, 'variants')}/products"
    given.select("id", variants.parsed("variants"), variants.parsed("attributes")).write.parquet(path)
    stored = spark.read.parquet(path)
    return stored.select(
        "id", variants.field("variants", "$.container", "string").alias("container"),
        variants.field("variants", "$.sizes[1]", "int").alias("second_size"),
        variants.field("attributes", "$.maker.brand", "string").alias("brand"),
        variants.field("attributes", "$.colour", "string").alias("colour"),
        variants.as_json("variants").alias("variants"))


SQL["S3_product_variants"] = """
SELECT p_partkey AS id, CASE WHEN p_size % 10 <> 0 THEN p_type END AS container,
       CAST(CASE WHEN p_size % 10 <> 0 THEN p_size + 1 END AS INTEGER) AS second_size, p_brand AS brand,
       CAST(NULL AS VARCHAR) AS colour,
       CASE WHEN p_size % 10 <> 0 THEN '{"container":' || CAST(to_json(p_type) AS VARCHAR) || ',"sizes":['
            || p_size || ',' || (p_size + 1) || ']}' ELSE '{}' END AS variants
FROM part"""


# ------------------------------------------------------------ order as a column

@plan("O1_products_in_order")
def o1(spark, d):
    """L2's order over all tenants: tenant, then id."""
    return with_position(listing.list_products(B.products(spark, d)).select("id", "tenant_id", "name"),
                         pg_asc("tenant_id"), pg_asc("id"))


SQL["O1_products_in_order"] = with_ctes("products") + """
SELECT id, tenant_id, name, row_number() OVER (ORDER BY tenant_id NULLS LAST, id) AS position
FROM products WHERE is_active"""


@plan("O2_categories_in_order")
def o2(spark, d):
    """L8's order, parents that are NULL first, over the users' custom roles: role, then time, then id."""
    users = B.users(spark, d).select("id", "tenant_id", "tenant_role_id", "created_at")
    return with_position(users, nulls_first("tenant_role_id"), pg_desc("created_at"), pg_asc("id"))


SQL["O2_categories_in_order"] = with_ctes("users") + """
SELECT id, tenant_id, tenant_role_id, created_at,
       row_number() OVER (ORDER BY tenant_role_id NULLS FIRST, created_at DESC NULLS FIRST, id NULLS LAST) AS position
FROM users"""


@plan("O3_invoices_by_expression")
def o3(spark, d):
    """L4's order with an expression in front: days since the year began, newest first, within each tenant."""
    inv = B.invoice_headers(spark, d).select(F.col("request_id").alias("id"), "tenant_id", "created_at")
    return with_position(inv, F.dayofyear("created_at").desc_nulls_first(), pg_desc("created_at"), pg_asc("id"),
                         within=("tenant_id",))


SQL["O3_invoices_by_expression"] = with_ctes("headers") + """
SELECT request_id AS id, tenant_id, created_at, row_number() OVER (PARTITION BY tenant_id
         ORDER BY dayofyear(created_at) DESC NULLS FIRST, created_at DESC NULLS FIRST, request_id) AS position
FROM headers"""


@plan("O4_daily_sales_in_order")
def o4(spark, d):
    """R2's order: newest day first within each tenant."""
    return with_position(reports.daily_sales(priced(spark, d)), pg_desc("sale_date"), within=("tenant_id",))


SQL["O4_daily_sales_in_order"] = _PRICED_V3 + """
SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY sale_date DESC NULLS FIRST) AS position FROM (
  SELECT tenant_id, CAST(created_at AS DATE) AS sale_date, CAST(SUM(grand_total) AS DECIMAL(38,2)) AS total_revenue,
         COUNT(id) AS total_invoices
  FROM priced GROUP BY ALL)"""


# ------------------------------------------------------------ pruned look-ups

KIND = "bakery"


@plan("F1_products_of_live_bakeries")
def f1_pruned(spark, d):
    """F1 on products stored by tenant folder: only folders of the tenants that the small side leaves are read."""
    path = f"{run_folder(spark, 'f1')}/products"
    append_partitioned(B.products(spark, d), path)
    some = B.tenants(spark, d).filter(P.is_live() & (F.col("business_type") == KIND)).select(F.col("id").alias("tenant_id"))
    return spark.read.parquet(path).join(F.broadcast(some), "tenant_id").select("id", "tenant_id", "name")


SQL["F1_products_of_live_bakeries"] = with_ctes("products", "tenants") + f"""
SELECT p.id, p.tenant_id, p.name FROM products p JOIN tenants t ON t.id = p.tenant_id
WHERE t.is_active AND t.business_type = '{KIND}'"""

#: Invoices that are looked up; each by its own tenant, the last by another's.
ASKED = [(11, None), (512, None), (1203, None), (1400, 99)]


@plan("F11_stored_look_up")
def f11_pruned(spark, d):
    """F11 on invoices stored in buckets by id: only the buckets of the ids asked for are read."""
    folder = run_folder(spark, "f11")
    name = folder.rsplit("/", 1)[-1].replace("-", "_")
    inv = B.invoice_headers(spark, d).withColumnRenamed("request_id", "id").select(
        "id", "tenant_id", "customer_id", "invoice_status", "created_at")
    write_bucketed(inv, name, "id", 32, f"{folder}/invoices")
    asked = [F.col("id") == i if t is None else (F.col("id") == i) & (F.col("tenant_id") == t) for i, t in ASKED]
    return spark.table(name).filter(F.col("id").isin([i for i, _ in ASKED]) & P.any_of(*asked))


SQL["F11_stored_look_up"] = with_ctes("headers") + f"""
SELECT request_id AS id, tenant_id, customer_id, invoice_status, created_at FROM headers
WHERE request_id IN ({', '.join(str(i) for i, t in ASKED if t is None)})
   OR (request_id = {ASKED[-1][0]} AND tenant_id = {ASKED[-1][1]})"""


# ------------------------------------------------------------ table functions

def publish(spark, d) -> list[str]:
    """All tables of the binding as views, with every table function over them."""
    users, menus = B.users(spark, d), seeds.menus(spark)
    roles, grants = B.tenant_roles(spark, d), B.tenant_role_permissions(spark, d)
    return sql_functions.register(
        spark, priced(spark, d), B.invoice_lines(spark, d), B.products(spark, d), B.customers(spark, d),
        tenants=B.tenants(spark, d), users=users, tenant_roles=roles, business_types=seeds.business_types(spark),
        uoms=seeds.uom_templates(spark), hsns=seeds.hsn_templates(spark), categories=seeds.category_templates(spark),
        tenant_features=B.tenant_features(spark, d),
        user_menus=access.user_menus(users, menus, seeds.role_grants(spark), grants),
        role_menus=access.tenant_role_menu_configs(menus, roles, grants))


def _for_each(spark, d, function: str) -> DataFrame:
    publish(spark, d)
    return spark.sql(f"SELECT t.id AS tenant_id, r.* FROM tenants t, LATERAL {function}(t.id) r")


@plan("R1_summary_per_row")
def r1_lateral(spark, d):
    """2.11: the summary function called for every tenant of a table."""
    return _for_each(spark, d, "tenant_sales_summary")


@plan("R2_daily_per_row")
def r2_lateral(spark, d):
    return _for_each(spark, d, "tenant_daily_sales")


@plan("R3_top_products_per_row")
def r3_lateral(spark, d):
    return _for_each(spark, d, "tenant_top_products")


@plan("R4_methods_per_row")
def r4_lateral(spark, d):
    return _for_each(spark, d, "tenant_payment_methods")


@plan("L2_products_per_row")
def l2_lateral(spark, d):
    """RETURNS SETOF: all columns of the product table, for every tenant of a table."""
    publish(spark, d)
    return spark.sql("SELECT r.* FROM tenants t, LATERAL list_products(t.id) r WHERE t.is_active")


SQL["L2_products_per_row"] = with_ctes("products", "tenants") + """
SELECT p.* FROM products p JOIN tenants t ON t.id = p.tenant_id WHERE t.is_active AND p.is_active"""


@plan("Function_calls")
def calls(spark, d):
    """One call of each listing function: how many rows it returns. (Reports have plans of their own.)"""
    made = [n for n in publish(spark, d) if n.startswith(("list_", "get_")) and n != "list_invoices"]
    arguments = {"get_invoice": "11, 3", "get_menus": "11", "list_menus_for_tenant_role": "3", "list_tenants": "",
                 "list_business_types": "", **{n: "CAST(NULL AS INT)" for n in ("list_uom", "list_hsn", "list_categories")}}
    parts = [f"SELECT '{n}' AS function, count(*) AS rows FROM {n}({arguments.get(n, '3')})" for n in sorted(made)]
    return spark.sql(" UNION ALL ".join(parts))
