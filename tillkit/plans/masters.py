"""Registered plans over masters: category trees, provisioned masters, grants, deactivated tenants.

Tenants are shops, one per supplier (``plans.requests``). Importing this module
adds to ``catalog.PLANS``; ``SQL`` has the DuckDB form of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillkit.functions import text as X
from tillkit.functions.ordering import nulls_first, pg_asc
from tillkit.operators import listing, maintenance, pricing, quality
from tillkit.operators.numbering import assign_ids, with_position
from tillkit.plans.catalog import plan
from tillkit.plans.oracle import priced_ctes, with_ctes
from tillkit.plans.requests import _SHOPS, _TYPES, SQL as _REQUESTS, shops, worklist
from tillkit.sources import binding as B
from tillkit.sources import products as full
from tillkit.sources import seeds
from tillkit.sources.tables import read_table

SQL: dict[str, str] = {}

#: Whose listing the one-tenant forms show, and which business type.
SHOP, KIND = 6, 2


# ------------------------------------------------------------ category trees

def tree_templates(spark, d) -> DataFrame:
    """Templates of three levels: the parts' types, and below them the two words of the parts' names."""
    p = read_table(spark, d, "part")
    kind = (F.ascii("p_type") % 5 + 1).cast("int").alias("business_type_id")
    words = F.split("p_name", " ")
    paths = p.select(kind, F.explode(F.array(
        F.array("p_type"), F.array(F.col("p_type"), words[0]),
        F.array(F.col("p_type"), words[0], words[1]))).alias("path")).distinct()
    made = assign_ids(paths.withColumn("depth", F.size("path")), ["depth", "path"])
    up = made.select(F.col("path").alias("_p"), F.col("id").alias("parent_id"))
    return made.join(up, F.slice("path", F.lit(1), F.col("depth") - 1) == F.col("_p"), "left").select(
        F.col("id").cast("int").alias("id"), F.element_at("path", -1).alias("name"),
        F.col("parent_id").cast("int").alias("parent_id"), F.lit(None).cast("int").alias("tenant_id"),
        "business_type_id", F.lit(True).alias("is_active"))


def provisioned_tree(spark, d) -> DataFrame:
    return maintenance.provision_categories(worklist(spark, d), tree_templates(spark, d))


@plan("J5_category_tree")
def j5(spark, d):
    """M7 with J5 over three levels: each shop's categories, with id, parent and path."""
    own = maintenance.category_paths(provisioned_tree(spark, d).filter(F.col("tenant_id").isNotNull()))
    parent = F.when(F.col("depth") > 0, F.element_at("path", F.col("depth")))
    return own.select("id", "tenant_id", "business_type_id", "parent_id", "name", parent.alias("parent_name"),
                      F.array_join("path", "/").alias("path"), "depth")


_TREE = f"""{_SHOPS}, {_TYPES},
shelf AS (
  SELECT DISTINCT CAST(ascii(p_type) % 5 + 1 AS INTEGER) AS business_type_id, unnest([[p_type],
    [p_type, string_split(p_name, ' ')[1]], [p_type, string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]]]) AS path
  FROM part),
templates AS (
  SELECT t.*, CAST(row_number() OVER (ORDER BY len(path), path) AS INTEGER) AS id FROM shelf t),
copies AS (
  SELECT s.id AS tenant_id, t.business_type_id, t.path, len(t.path) - 1 AS depth,
         CAST((SELECT count(*) FROM templates) + row_number() OVER (ORDER BY len(t.path), s.id, t.path) AS INTEGER) AS id
  FROM shops s JOIN business_types b ON b.name = s.business_type JOIN templates t ON t.business_type_id = b.id
  WHERE s.is_active)"""
SQL["J5_category_tree"] = f"""WITH {_TREE}
SELECT c.id, c.tenant_id, c.business_type_id, p.id AS parent_id, c.path[-1] AS name,
       CASE WHEN c.depth > 0 THEN c.path[-2] END AS parent_name, array_to_string(c.path, '/') AS path,
       CAST(c.depth AS INTEGER) AS depth
FROM copies c LEFT JOIN copies p ON p.tenant_id = c.tenant_id AND p.path = c.path[1:c.depth] AND c.depth > 0"""


# ------------------------------------------------------------ listings of masters

@plan("L8_tenant_categories")
def l8(spark, d):
    """L8, strict scope (F6): one shop's categories, parents that are NULL first, with their place."""
    rows = listing.list_categories(provisioned_tree(spark, d), SHOP)
    return with_position(rows.select("id", "name", "parent_id"), nulls_first("parent_id"), pg_asc("name"), pg_asc("id"))


SQL["L8_tenant_categories"] = f"""WITH {_TREE}
SELECT c.id, c.path[-1] AS name, p.id AS parent_id,
       row_number() OVER (ORDER BY p.id NULLS FIRST, c.path[-1] NULLS LAST, c.id) AS position
FROM copies c LEFT JOIN copies p ON p.tenant_id = c.tenant_id AND p.path = c.path[1:c.depth] AND c.depth > 0
WHERE c.tenant_id = {SHOP}"""


@plan("L8_template_categories")
def l8_templates(spark, d):
    """L8 without a tenant: the templates of one business type (strict F7)."""
    return listing.list_categories(provisioned_tree(spark, d), None, KIND).select("id", "name", "business_type_id")


SQL["L8_template_categories"] = f"""WITH {_TREE}
SELECT id, path[-1] AS name, business_type_id FROM templates WHERE business_type_id = {KIND}"""


@plan("L8_shared_categories")
def l8_shared(spark, d):
    """L8, earlier form: templates and one shop's own (F6a), of its business type or of none."""
    return listing.list_categories_shared(provisioned_tree(spark, d), SHOP, KIND).select("id", "name", "tenant_id")


SQL["L8_shared_categories"] = f"""WITH {_TREE}
SELECT id, path[-1] AS name, CAST(NULL AS INTEGER) AS tenant_id FROM templates WHERE business_type_id = {KIND}
UNION ALL
SELECT id, path[-1], tenant_id FROM copies WHERE tenant_id = {SHOP} AND business_type_id = {KIND}"""


def _copied(sql: str, columns: str) -> str:
    return f"SELECT {columns}, position FROM (SELECT * FROM ({sql}) WHERE tenant_id = {SHOP})"


@plan("L7_tenant_uoms")
def l7(spark, d):
    """L7 and F6 over the units copied to every shop, with their place; X16 is how they are stored."""
    rows = listing.list_uom(maintenance.provision_uoms(worklist(spark, d), seeds.uom_templates(spark)), SHOP)
    return with_position(rows.select("name", "abbreviation", X.upper("abbreviation").alias("code")), pg_asc("name"))


SQL["L7_tenant_uoms"] = f"""
SELECT name, abbreviation, upper(abbreviation) AS code, row_number() OVER (ORDER BY name) AS position
FROM ({_REQUESTS['M7_provision_uoms']}) WHERE tenant_id = {SHOP}"""


@plan("L9_tenant_hsns")
def l9(spark, d):
    """L9 and F6 over the codes copied to every shop, with their place."""
    rows = listing.list_hsn(maintenance.provision_hsns(worklist(spark, d), seeds.hsn_templates(spark)), SHOP)
    return with_position(rows.select("hsn_code", "igst_rate"), pg_asc("hsn_code"))


SQL["L9_tenant_hsns"] = f"""
SELECT hsn_code, igst_rate, row_number() OVER (ORDER BY hsn_code) AS position
FROM ({_REQUESTS['M7_provision_hsns']}) WHERE tenant_id = {SHOP}"""


# ------------------------------------------------------------ grants, deactivation

GRANTED = ("reports", "billing")


@plan("M13_grant_by_predicate")
def m13(spark, d):
    """M13 for every custom role at once: two menus by route, only where the role has none of them yet."""
    return maintenance.grant_to_roles(
        B.tenant_role_permissions(spark, d), seeds.menus(spark), B.tenant_roles(spark, d).select("id"),
        GRANTED, [True, False, False, False], "tenant_role_id")


SQL["M13_grant_by_predicate"] = with_ctes("menus", "role_permissions", "tenant_role_permissions", "tenant_roles") + f"""
SELECT * FROM tenant_role_permissions
UNION ALL
SELECT r.id, m.id, TRUE, FALSE, FALSE, FALSE
FROM tenant_roles r CROSS JOIN menus m
WHERE m.route IN {GRANTED} AND NOT EXISTS (
  SELECT 1 FROM tenant_role_permissions p WHERE p.tenant_role_id = r.id AND p.menu_id = m.id)"""


@plan("M9_cascade_deactivate_tenants")
def m9(spark, d):
    """M9, the tenants' half: shops of region 4 close, and the roles that belong to them."""
    region = read_table(spark, d, "nation").where("n_regionkey = 4").select("n_nationkey")
    gone = read_table(spark, d, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    roles = B.tenant_roles(spark, d).withColumn("tenant_id", F.col("id").cast("int"))  # a shop's own role
    tenants, left = maintenance.cascade_deactivate(
        shops(spark, d), roles, gone.select(F.col("s_suppkey").cast("int").alias("id")))
    return tenants.select("id", F.col("is_active").alias("open")).join(
        left.select(F.col("tenant_id").alias("id"), F.col("is_active").alias("role_live")), "id")


SQL["M9_cascade_deactivate_tenants"] = f"""WITH {_SHOPS}
SELECT s.id, s.is_active AND n.n_regionkey <> 4 AS open, s.is_active AND n.n_regionkey <> 4 AS role_live
FROM shops s JOIN supplier x ON x.s_suppkey = s.id JOIN nation n ON n.n_nationkey = x.s_nationkey"""


@plan("M16_menu_with_grants")
def m16(spark, d):
    """A menu below a parent found by name, once, and a grant of it to every custom role."""
    menus = seeds.menus(spark)
    for _ in range(2):  # the second time it is there
        menus, _perms = maintenance.add_menu_with_grants(
            menus, seeds.role_grants(spark), "Kitchen", "billing/kitchen", "coffee", "Billing", 3, [])
    new = menus.filter(F.col("route") == "billing/kitchen")
    perms = maintenance.grant_to_roles(B.tenant_role_permissions(spark, d), menus, B.tenant_roles(spark, d).select("id"),
                                       ["billing/kitchen"], [True, True, False, False], "tenant_role_id")
    return perms.join(new.select(F.col("id").alias("menu_id"), "parent_id", "name"), "menu_id")


SQL["M16_menu_with_grants"] = with_ctes("menus", "tenant_roles") + """
SELECT m.id AS menu_id, r.id AS tenant_role_id, TRUE AS can_view, TRUE AS can_add, FALSE AS can_edit,
       FALSE AS can_delete, m.parent_id, m.name
FROM tenant_roles r, (SELECT CAST(max(id) + 1 AS INTEGER) AS id, 'Kitchen' AS name,
                             (SELECT min(id) FROM menus WHERE name = 'Billing' AND parent_id IS NULL) AS parent_id
                      FROM menus) m"""


# ------------------------------------------------------------ products in full

NOW = "2024-05-06 07:08:09"


def products_in_full(spark, d) -> DataFrame:
    """The bound products with the retail columns: some from the parts, the others at their defaults."""
    part = read_table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.split("p_name", " ")[0].alias("subcategory"),
        F.col("p_size").cast("string").alias("size"), X.sku(F.col("p_partkey") % B.TENANT_COUNT, F.col("p_partkey")).alias("sku"))
    return full.full(B.products(spark, d).join(part, "id"))


_FULL = """full_products AS (
  SELECT p.id, p.tenant_id, name, category, price, stock_qty, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS VARCHAR) AS barcode,
         'SKU-' || (x.p_partkey % 25) || '-' || substr(lpad(CAST(x.p_partkey AS VARCHAR), 4, '0'), 1, 4) AS sku,
         CAST(x.p_size AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS color, CAST(NULL AS VARCHAR) AS imei,
         CAST(NULL AS DATE) AS expiry_date, is_active, CAST(NULL AS TIMESTAMP) AS created_at,
         string_split(x.p_name, ' ')[1] AS subcategory, brand, CAST(NULL AS VARCHAR) AS hsn_code,
         CAST(0 AS DECIMAL(20,6)) AS purchase_price, CAST(0 AS DECIMAL(20,6)) AS mrp, CAST(0 AS DECIMAL(20,6)) AS discount,
         'percent' AS discount_type, CAST(0 AS DECIMAL(20,6)) AS tax_percent, CAST(0 AS DECIMAL(20,6)) AS min_stock,
         CAST(0 AS DECIMAL(20,6)) AS reorder_level, CAST(NULL AS VARCHAR) AS batch_number, CAST(NULL AS DATE) AS mfg_date,
         '{}' AS variants, '{}' AS additional_attributes
  FROM products p JOIN part x ON x.p_partkey = p.id)"""


@plan("L2_list_products_full")
def l2_full(spark, d):
    """L2 with all 29 columns."""
    return listing.list_products(products_in_full(spark, d))


SQL["L2_list_products_full"] = with_ctes("products", _FULL) + "SELECT * FROM full_products WHERE is_active"


@plan("M5_create_products")
def m5_full(spark, d):
    """M5, latest form: a cheaper edition of every part of one size, with most columns given."""
    part = read_table(spark, d, "part").filter("p_size = 7")
    rows = part.select(
        F.col("p_partkey").alias("src"), (F.col("p_partkey") % B.TENANT_COUNT).cast("int").alias("tenant_id"),
        F.concat("p_name", F.lit(" mini")).alias("name"), F.col("p_type").alias("category"),
        (F.col("p_retailprice") / 2).cast("decimal(12,2)").alias("price"),
        F.col("p_retailprice").cast("decimal(20,6)").alias("mrp"), F.lit("fixed").alias("discount_type"),
        F.lit("2024-01-31").cast("date").alias("mfg_date"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit('{"edition":"mini"}')).alias("variants"))
    return full.create(products_in_full(spark, d), rows, ["src"], NOW)


SQL["M5_create_products"] = with_ctes("products", _FULL) + f"""
SELECT * FROM full_products
UNION ALL BY NAME
SELECT (SELECT max(id) FROM products) + row_number() OVER (ORDER BY p_partkey) AS id,
       CAST(p_partkey % 25 AS INTEGER) AS tenant_id, p_name || ' mini' AS name, p_type AS category,
       CAST(p_retailprice / 2 AS DECIMAL(12,2)) AS price, CAST(p_retailprice AS DECIMAL(20,6)) AS mrp,
       'fixed' AS discount_type, DATE '2024-01-31' AS mfg_date, TRUE AS is_active, TIMESTAMP '{NOW}' AS created_at,
       CASE WHEN p_partkey % 2 = 0 THEN '{{"edition":"mini"}}' ELSE '{{}}' END AS variants, '{{}}' AS additional_attributes
FROM part WHERE p_size = 7"""


@plan("M1_patch_products_full")
def m1_full(spark, d):
    """M1 on all columns: colour, tax and attributes of some parts; NULL fields change nothing."""
    part = read_table(spark, d, "part")
    changes = part.select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % B.TENANT_COUNT).cast("int").alias("tenant_id"),
        F.when(F.col("p_size") > 40, F.lit("red")).alias("color"),
        F.when(F.col("p_size") < 3, F.lit("12.5")).cast("decimal(20,6)").alias("tax_percent"),
        F.when(F.col("p_size") == 1, F.lit('{"box":1}')).alias("additional_attributes"))
    return full.patch(products_in_full(spark, d), changes).select(
        "id", "color", "tax_percent", "additional_attributes", "variants", "discount_type")


SQL["M1_patch_products_full"] = """
SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'red' END AS color,
       CAST(CASE WHEN p_size < 3 THEN 12.5 ELSE 0 END AS DECIMAL(20,6)) AS tax_percent,
       CASE WHEN p_size = 1 THEN '{"box":1}' ELSE '{}' END AS additional_attributes, '{}' AS variants,
       'percent' AS discount_type
FROM part"""


# ------------------------------------------------------------ business types, checks, first rows, time

@plan("X14_business_types_from_labels")
def x14(spark, d):
    """A business type per supplier's name: slug, the label again, and an empty feature array."""
    rows = read_table(spark, d, "supplier").select(F.concat(F.lit("Shop of "), "s_name").alias("label"))
    made = maintenance.create_business_types(seeds.business_types(spark), rows)
    return made.filter(F.col("name").startswith("shop_of")).select(
        "name", X.label(F.col("name")).alias("label_again"), F.size("default_features").alias("features"), "is_active")


SQL["X14_business_types_from_labels"] = """
SELECT DISTINCT replace(lower('Shop of ' || s_name), ' ', '_') AS name,
       list_aggregate(list_transform(string_split(lower('Shop of ' || s_name), ' '),
         lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS label_again, 0 AS features, TRUE AS is_active
FROM supplier"""


def _raw_status(spark, d) -> DataFrame:
    """Invoices loaded with the orders' own codes where the priority is low: no mapping was made for them."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    inv = B.invoice_headers(spark, d).select(F.col("request_id").alias("id"), "payment_status")
    return inv.join(o, "id").withColumn("payment_status", F.when(
        F.col("o_orderpriority").startswith("5"), F.col("o_orderstatus")).otherwise(F.col("payment_status")))


def _checked(table: str, column: str, key: str, rows: str, allowed) -> str:
    listed = ", ".join(f"'{x}'" for x in allowed)
    return (f"SELECT '{table}' AS table_name, 'check:{column}' AS rule, CAST({key} AS VARCHAR) AS row_key, "
            f"{column} AS value FROM ({rows}) x WHERE {column} IS NOT NULL AND {column} NOT IN ({listed})")


@plan("E3_raw_payment_status")
def e3(spark, d):
    return quality.check_allowed(_raw_status(spark, d), "invoices", "payment_status", seeds.PAYMENT_STATUSES, ["id"])


SQL["E3_raw_payment_status"] = with_ctes("headers") + _checked("invoices", "payment_status", "id", """
  SELECT request_id AS id, CASE WHEN o.o_orderpriority LIKE '5%' THEN o.o_orderstatus ELSE payment_status END AS payment_status
  FROM headers JOIN orders o ON o.o_orderkey = request_id""", seeds.PAYMENT_STATUSES)


@plan("E1_unknown_business_type")
def e1(spark, d):
    """Tenants whose type is the segment of a customer of that id: two of the segments are no business type."""
    c = read_table(spark, d, "customer")
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "manufacturing").when(
        F.col("c_mktsegment") == "HOUSEHOLD", "retail").otherwise(F.lower("c_mktsegment"))
    return quality.check_allowed(c.select(F.col("c_custkey").alias("id"), kind.alias("business_type")), "tenants",
                                 "business_type", seeds.BUSINESS_TYPES_V2, ["id"])


SQL["E1_unknown_business_type"] = _checked("tenants", "business_type", "id", """
  SELECT c_custkey AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'manufacturing' WHEN 'HOUSEHOLD' THEN 'retail'
         ELSE lower(c_mktsegment) END AS business_type FROM customer""", seeds.BUSINESS_TYPES_V2)


@plan("E4_kitchen_ticket_status")
def e4(spark, d):
    """Kitchen tickets from the events: a purchase is served, a view is pending, others keep the event's name."""
    e = read_table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "served").when(F.col("event_type") == "view", "pending").otherwise(
        F.col("event_type"))
    return quality.check_allowed(e.select(F.col("event_id").alias("id"), status.alias("status")), "kot", "status",
                                 seeds.KOT_STATUSES, ["id"])


SQL["E4_kitchen_ticket_status"] = _checked("kot", "status", "id", """
  SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'served' WHEN 'view' THEN 'pending' ELSE event_type END AS status
  FROM events""", seeds.KOT_STATUSES)


@plan("O6_first_invoices")
def o6(spark, d):
    """A plain limit, made deterministic by an order."""
    inv = B.invoice_headers(spark, d).select(F.col("request_id").alias("id"), "tenant_id", "created_at")
    return listing.some_rows(inv, 25, pg_asc("created_at"), pg_asc("id"))


SQL["O6_first_invoices"] = with_ctes("headers") + """
SELECT request_id AS id, tenant_id, created_at FROM headers ORDER BY created_at, request_id LIMIT 25"""


@plan("O7_latest_invoice_of_customer")
def o7(spark, d):
    """The first row by an order, or nothing."""
    inv = B.invoice_headers(spark, d).filter(F.col("customer_id") == 28).select(F.col("request_id").alias("id"), "created_at")
    return listing.first_row(inv, F.col("created_at").desc_nulls_first(), pg_asc("id"))


SQL["O7_latest_invoice_of_customer"] = with_ctes("headers") + """
SELECT request_id AS id, created_at FROM headers WHERE customer_id = 28 ORDER BY created_at DESC, request_id LIMIT 1"""


@plan("X11_priced_as_of")
def x11(spark, d):
    """X11: requests without a time of their own are stamped with the time given."""
    requests = B.invoice_headers(spark, d).drop("created_at")
    return pricing.price_invoice_lines(requests, B.invoice_lines(spark, d), as_of=NOW).select(
        "id", "grand_total", "created_at", F.to_date("created_at").alias("day"))


SQL["X11_priced_as_of"] = with_ctes(*priced_ctes("v3")) + f"""
SELECT id, grand_total, TIMESTAMP '{NOW}' AS created_at, DATE '{NOW[:10]}' AS day FROM priced"""
