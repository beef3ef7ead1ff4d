"""Registered plans in the shape of requests, and of provisioning.

Importing this module adds to ``catalog.PLANS``; ``SQL`` has the DuckDB form of
each. Tenants of the provisioning plans are ``shops``, one per supplier, so
that the work grows with the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillkit.functions import predicates as P
from tillkit.operators import access, generate, listing, maintenance, pricing, quality, reports
from tillkit.plans.catalog import RANGE_END, RANGE_START, plan, priced
from tillkit.plans.oracle import CTE, _values, priced_ctes, with_ctes
from tillkit.session import ensure_checkpoint_dir
from tillkit.sources import binding as B
from tillkit.sources import schemas, seeds
from tillkit.sources.tables import append_partitioned, as_json_rows, read_table

SQL: dict[str, str] = {}

TENANT, CUSTOMER = 3, 28  # the parameters of the one-tenant forms; 28 % 25 = 3

_PRICED = ("id, tenant_id, customer_id, subtotal, discount_total, tax_total, grand_total, "
           "payment_method, payment_status, created_at")
_PRICED_V3 = with_ctes(*priced_ctes("v3"))
_SCOPED = (f"tenant_id = {TENANT} AND created_at >= TIMESTAMP '{RANGE_START} 00:00:00' AND "
           f"created_at <= CAST(DATE '{RANGE_END}' + INTERVAL 1 DAY AS TIMESTAMP)")


# ------------------------------------------------------------ nested items

def nested_requests(spark, d) -> DataFrame:
    """Invoice requests whose items are JSON text, as the JSONB column holds them."""
    r = B.invoice_requests(spark, d)
    return r.withColumn("items", schemas.items_json(F.col("items")))


@plan("B1_price_nested")
def b1_nested(spark, d):
    """B1 and the fold A7 on JSON items: decode, fold, no shuffle after the arrays."""
    return pricing.price_invoices(nested_requests(spark, d)).select(
        *_PRICED.replace(" ", "").split(","), "paid_amount", "balance", "invoice_status", "bill_discount")


SQL["B1_price_nested"] = _PRICED_V3 + f"SELECT {_PRICED}, paid_amount, balance, invoice_status, bill_discount FROM priced"


@plan("S2_items_json")
def s2(spark, d):
    """S3 encodes, S2 decodes: the lines that come back."""
    return pricing.explode_items(nested_requests(spark, d)).withColumnRenamed("request_id", "invoice_id")


SQL["S2_items_json"] = with_ctes("lines", "headers") + """
SELECT l.invoice_id, h.tenant_id, product_id, quantity, unit_price, discount, discount_type, tax_percent
FROM lines l JOIN headers h ON h.request_id = l.invoice_id"""


@plan("R3_top_products_nested")
def r3_nested(spark, d):
    """R3 from the nested items: explode (J6), then the sums."""
    req = nested_requests(spark, d)
    lines = pricing.explode_items(req, ("request_id",)).withColumnRenamed("request_id", "invoice_id")
    inv = B.invoice_headers(spark, d).withColumnRenamed("request_id", "id")
    return reports.top_products(inv, lines, B.products(spark, d))


# ------------------------------------------------------------ one tenant

def _scope(spark, d, customer=None):
    return dict(tenant_id=TENANT, start=RANGE_START, end=RANGE_END, customer_id=customer)


@plan("R1_tenant_summary")
def r1_tenant(spark, d):
    return reports.sales_summary(priced(spark, d, start=RANGE_START, end=RANGE_END), **_scope(spark, d))


@plan("R1_customer_summary")
def r1_customer(spark, d):
    return reports.sales_summary(priced(spark, d, start=RANGE_START, end=RANGE_END), **_scope(spark, d, CUSTOMER))


@plan("R2_tenant_daily")
def r2_tenant(spark, d):
    return reports.daily_sales(priced(spark, d, start=RANGE_START, end=RANGE_END), **_scope(spark, d))


@plan("R4_tenant_methods")
def r4_tenant(spark, d):
    return reports.payment_methods(priced(spark, d, start=RANGE_START, end=RANGE_END), **_scope(spark, d))


@plan("R3_tenant_top")
def r3_tenant(spark, d):
    inv = B.invoice_headers(spark, d).withColumnRenamed("request_id", "id")
    return reports.top_products(inv, B.invoice_lines(spark, d), B.products(spark, d), **_scope(spark, d))


_SUMS = """SELECT COALESCE(CAST(SUM(grand_total) AS DECIMAL(38,2)), 0) AS total_revenue, COUNT(id) AS total_invoices,
       COALESCE(CAST(SUM(tax_total) AS DECIMAL(38,2)), 0) AS total_tax,
       COALESCE(CAST(SUM(discount_total) AS DECIMAL(38,2)), 0) AS total_discount
FROM priced WHERE """
SQL["R1_tenant_summary"] = _PRICED_V3 + _SUMS + _SCOPED
SQL["R1_customer_summary"] = _PRICED_V3 + _SUMS + _SCOPED + f" AND customer_id = {CUSTOMER}"
SQL["R2_tenant_daily"] = _PRICED_V3 + f"""
SELECT CAST(created_at AS DATE) AS sale_date, CAST(SUM(grand_total) AS DECIMAL(38,2)) AS total_revenue,
       COUNT(id) AS total_invoices
FROM priced WHERE {_SCOPED} GROUP BY 1 ORDER BY 1 DESC"""
SQL["R4_tenant_methods"] = _PRICED_V3 + f"""
SELECT payment_method, COUNT(id) AS total_invoices, CAST(SUM(grand_total) AS DECIMAL(38,2)) AS total_revenue
FROM priced WHERE {_SCOPED} GROUP BY 1"""
SQL["R3_tenant_top"] = with_ctes("lines", "headers", "products") + f"""
SELECT p.name AS product_name, CAST(SUM(l.quantity) AS DECIMAL(38,3)) AS total_qty,
       CAST(SUM(l.quantity * l.unit_price - COALESCE(l.discount, 0)) AS DECIMAL(38,8)) AS total_revenue
FROM lines l JOIN headers i ON i.request_id = l.invoice_id JOIN products p ON p.id = l.product_id
WHERE i.{_SCOPED.replace('created_at', 'i.created_at')}
GROUP BY p.name ORDER BY total_revenue DESC, product_name LIMIT 10"""


@plan("F11_get_invoices")
def f11(spark, d):
    """Look-ups of every order by its own tenant, and of every third by another's."""
    o = read_table(spark, d, "orders")
    asked = o.select(F.col("o_orderkey").alias("id"), F.when(
        F.col("o_orderkey") % 3 == 0, F.lit(B.TENANT_COUNT).cast("int")).otherwise(
        (F.col("o_custkey") % B.TENANT_COUNT).cast("int")).alias("tenant_id"))
    inv = B.invoice_headers(spark, d).withColumnRenamed("request_id", "id")
    return listing.get_invoices(inv, asked).select("id", "tenant_id", "invoice_status")


SQL["F11_get_invoices"] = with_ctes("headers") + """
SELECT request_id AS id, tenant_id, invoice_status FROM headers WHERE request_id % 3 <> 0"""


@plan("Path3_menu_response")
def menu_endpoint(spark, d):
    """The menus endpoint for every user; lists are joined to text."""
    out = access.menu_response(B.users(spark, d), seeds.menus(spark), seeds.role_grants(spark),
                               B.tenant_role_permissions(spark, d), B.tenant_features(spark, d), B.tenants(spark, d))
    on = F.map_filter("features", lambda k, v: v)
    return out.select("user_id", "tenant_id", "tenant_name", "theme_color",
                      F.array_join(F.transform("menus", lambda m: m["name"]), "|").alias("menus"),
                      F.array_join(F.array_sort(F.map_keys(on)), "|").alias("features"))


SQL["Path3_menu_response"] = with_ctes("users", "menus", "role_permissions", "tenant_role_permissions", "tenants",
                                       "features", "tenant_features") + f"""
, granted AS (
  SELECT u.id AS user_id, p.menu_id FROM users u JOIN tenant_role_permissions p
    ON p.tenant_role_id = u.tenant_role_id WHERE p.can_view
  UNION ALL
  SELECT u.id, p.menu_id FROM users u JOIN role_permissions p ON p.role_id = u.role_id
  WHERE u.tenant_role_id IS NULL AND p.can_view),
listed AS (
  SELECT user_id, string_agg(m.name, '|' ORDER BY m.parent_id NULLS FIRST, m.sort_order, m.name) AS menus
  FROM granted g JOIN menus m ON m.id = g.menu_id WHERE m.is_active GROUP BY user_id),
flags AS (
  SELECT tenant_id, string_agg(feature_key, '|' ORDER BY feature_key) AS features
  FROM tenant_features WHERE enabled GROUP BY tenant_id)
SELECT u.id AS user_id, u.tenant_id,
       CASE WHEN t.name IS NULL OR t.name = '' THEN '{seeds.DEFAULT_TENANT_NAME}' ELSE t.name END AS tenant_name,
       CASE WHEN t.theme_color IS NULL OR t.theme_color = '' THEN '{seeds.DEFAULT_THEME_COLOR}'
            ELSE t.theme_color END AS theme_color,
       COALESCE(l.menus, '') AS menus, COALESCE(f.features, '') AS features
FROM users u LEFT JOIN tenants t ON t.id = u.tenant_id LEFT JOIN listed l ON l.user_id = u.id
LEFT JOIN flags f ON f.tenant_id = u.tenant_id"""


@plan("J4_role_menu_configs")
def j4(spark, d):
    return access.tenant_role_menu_configs(seeds.menus(spark), B.tenant_roles(spark, d),
                                           B.tenant_role_permissions(spark, d)).drop("icon")


SQL["J4_role_menu_configs"] = with_ctes("menus", "tenant_roles", "role_permissions", "tenant_role_permissions") + f"""
SELECT r.id AS tenant_role_id, m.id AS menu_id, m.name AS menu_name, m.route, m.parent_id, m.sort_order,
       COALESCE(p.can_view, FALSE) AS can_view, COALESCE(p.can_add, FALSE) AS can_add,
       COALESCE(p.can_edit, FALSE) AS can_edit, COALESCE(p.can_delete, FALSE) AS can_delete
FROM tenant_roles r CROSS JOIN menus m
LEFT JOIN tenant_role_permissions p ON p.tenant_role_id = r.id AND p.menu_id = m.id
WHERE m.route IS NULL OR m.route NOT IN ({', '.join(f"'{x}'" for x in seeds.SUPER_ADMIN_ONLY_ROUTES)})"""


# ------------------------------------------------------------ provisioning

def shops(spark, d) -> DataFrame:
    """Tenants, one per supplier."""
    s = read_table(spark, d, "supplier")
    kinds = F.array(*[F.lit(b) for b in seeds.BUSINESS_TYPES_V1])
    return s.select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("name"),
                    F.element_at(kinds, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("business_type"),
                    F.lit(None).cast("int").alias("business_type_id"), (F.col("s_acctbal") >= 0).alias("is_active"),
                    F.when(F.col("s_suppkey") % 4 == 0, F.lit(None).cast("string")).otherwise(B.THEME_COLOR)
                    .alias("theme_color"))


_SHOPS = f"""shops AS (
  SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS name,
         CASE s_suppkey % 5 {' '.join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(seeds.BUSINESS_TYPES_V1))} END
           AS business_type, s_acctbal >= 0 AS is_active,
         CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '{B.THEME_COLOR}' END AS theme_color
  FROM supplier)"""


def linked_shops(spark, d) -> DataFrame:
    return access.link_business_types(shops(spark, d), seeds.business_types(spark))


def shop_features(spark, d) -> DataFrame:
    f = seeds.features_by_business_type(spark)
    return shops(spark, d).join(f, "business_type").select(F.col("id").alias("tenant_id"), "feature_key", "enabled")


def worklist(spark, d) -> DataFrame:
    """Live shops with a business type."""
    return access.provisioning_worklist(linked_shops(spark, d), seeds.business_types(spark)).select(
        F.col("id").alias("tenant_id"), "business_type_id")


@plan("L1_list_tenants")
def l1(spark, d):
    return listing.list_tenants(shops(spark, d)).select("id", "name", "business_type", "is_active")


SQL["L1_list_tenants"] = f"WITH {_SHOPS} SELECT id, name, business_type, is_active FROM shops"


@plan("L5_tenant_features")
def l5(spark, d):
    return listing.tenant_features(shop_features(spark, d))


_FEATURES = CTE["features"].strip()
SQL["L5_tenant_features"] = f"""WITH {_SHOPS}, {_FEATURES}
SELECT s.id AS tenant_id, feature_key, enabled FROM shops s JOIN features f USING (business_type)"""


@plan("J12_tenants_with_features")
def j12(spark, d):
    return access.tenants_with_features(shops(spark, d), shop_features(spark, d), seeds.BUSINESS_TYPES_V1[1])


SQL["J12_tenants_with_features"] = f"""WITH {_SHOPS}, {_FEATURES}
SELECT s.name AS tenant_name, s.business_type, CASE WHEN feature_key IS NOT NULL THEN s.id END AS tenant_id,
       feature_key, enabled
FROM shops s LEFT JOIN features f USING (business_type)
WHERE s.business_type = '{seeds.BUSINESS_TYPES_V1[1]}'"""


@plan("J14_provisioning_worklist")
def j14(spark, d):
    return access.provisioning_worklist(linked_shops(spark, d), seeds.business_types(spark))


_TYPES = CTE["business_types"].strip()
SQL["J14_provisioning_worklist"] = f"""WITH {_SHOPS}, {_TYPES}
SELECT s.id, s.name, b.id AS business_type_id, b.name AS biz_name
FROM shops s JOIN business_types b ON b.name = s.business_type WHERE s.is_active"""


def _categories(spark) -> DataFrame:
    """Templates (S7): the lists of each business type, and one child each."""
    from tillkit.operators.generate import seed_category_templates

    return seed_category_templates(seeds.category_templates(spark).limit(0), seeds.business_types(spark))


@plan("M7_provision_categories")
def m7_categories(spark, d):
    out = maintenance.provision_categories(worklist(spark, d), _categories(spark))
    return out.filter(F.col("tenant_id").isNotNull()).select("tenant_id", "business_type_id", "name")


_TEMPLATES = _values([(b, n) for b, names in seeds.CATEGORY_TEMPLATES.items() for n in names], ["bt", "name"])
SQL["M7_provision_categories"] = f"""WITH {_SHOPS}, {_TYPES}
SELECT s.id AS tenant_id, b.id AS business_type_id, t.name
FROM shops s JOIN business_types b ON b.name = s.business_type JOIN (SELECT * FROM {_TEMPLATES}) t ON t.bt = b.name
WHERE s.is_active"""


@plan("M7_provision_uoms")
def m7_uoms(spark, d):
    out = maintenance.provision_uoms(worklist(spark, d), seeds.uom_templates(spark))
    return out.filter(F.col("tenant_id").isNotNull()).select("id", "tenant_id", "name", "abbreviation")


SQL["M7_provision_uoms"] = f"""WITH {_SHOPS}, {_TYPES},
units(name, abbreviation) AS (SELECT * FROM {_values(seeds.UOMS, ['n', 'a'])})
SELECT CAST({len(seeds.UOMS)} + row_number() OVER (ORDER BY s.id, u.abbreviation) AS INTEGER) AS id, s.id AS tenant_id, u.name,
       u.abbreviation
FROM shops s JOIN business_types b ON b.name = s.business_type CROSS JOIN units u WHERE s.is_active"""


@plan("M7_provision_hsns")
def m7_hsns(spark, d):
    out = maintenance.provision_hsns(worklist(spark, d), seeds.hsn_templates(spark))
    return out.filter(F.col("tenant_id").isNotNull()).select("tenant_id", "hsn_code", "description", "igst_rate")


SQL["M7_provision_hsns"] = f"""WITH {_SHOPS}, {_TYPES},
codes AS (SELECT * FROM {_values([(a, b, str(e)) for a, b, _, _, e in seeds.HSNS], ['hsn_code', 'description', 'rate'])})
SELECT s.id AS tenant_id, c.hsn_code, c.description, CAST(c.rate AS DECIMAL(5,2)) AS igst_rate
FROM shops s JOIN business_types b ON b.name = s.business_type CROSS JOIN codes c WHERE s.is_active"""


@plan("M8_create_tenants")
def m8(spark, d):
    """Every supplier becomes a tenant after the nations, with its features."""
    new = shops(spark, d).select("name", "business_type")
    tenants, features = maintenance.create_tenants(
        B.tenants(spark, d), new, seeds.business_types(spark), seeds.features_by_business_type(spark),
        B.tenant_features(spark, d))
    return tenants.join(features.withColumnRenamed("tenant_id", "id"), "id", "left").select(
        "id", "name", "business_type", "feature_key", "enabled")


SQL["M8_create_tenants"] = with_ctes("tenants", "features") + f""", {_SHOPS},
every AS (
  SELECT id, name, business_type FROM tenants
  UNION ALL
  SELECT CAST((SELECT max(id) FROM tenants) + row_number() OVER (ORDER BY name, business_type) AS INTEGER),
         name, business_type FROM shops)
SELECT e.id, e.name, e.business_type, f.feature_key, f.enabled
FROM every e LEFT JOIN features f USING (business_type)"""


@plan("S9_seed_tables")
def s9(spark, d):
    """Tables of every shop that manages tables."""
    none = spark.createDataFrame([], "id int, tenant_id int, table_number string, capacity int, is_occupied boolean")
    made = generate.seed_tables(none, shop_features(spark, d))
    return listing.list_tables(made)


SQL["S9_seed_tables"] = f"""WITH {_SHOPS}, {_FEATURES}
SELECT s.id AS tenant_id, CAST(row_number() OVER (ORDER BY s.id, i) AS INTEGER) AS id,
       CAST(i AS VARCHAR) AS table_number, {seeds.SEEDED_TABLE_CAPACITY} AS capacity, FALSE AS is_occupied
FROM shops s JOIN features f USING (business_type), range(1, {seeds.SEEDED_TABLES_PER_TENANT + 1}) t(i)
WHERE f.feature_key = 'table_mgmt' AND f.enabled"""


@plan("S8_synthetic_products")
def s8(spark, d):
    """Row set, SKU, barcode and ranges of the generated products."""
    p = generate.synthetic_products(shops(spark, d))
    return p.select("tenant_id", "sku", "barcode", F.col("price").between(10, 2000).alias("price_ok"),
                    F.col("stock_qty").between(10, 500).alias("stock_ok"))


_CODES = f"FROM shops s, range(1, {generate.PRODUCTS_PER_TENANT + 1}) t(i)"
SQL["S8_synthetic_products"] = f"""WITH {_SHOPS}
SELECT s.id AS tenant_id, 'SKU-' || s.id || '-' || lpad(CAST(i AS VARCHAR), 4, '0') AS sku,
       '8901234' || lpad(CAST(i AS VARCHAR), 6, '0') AS barcode, TRUE AS price_ok, TRUE AS stock_ok {_CODES}"""


# ------------------------------------------------------------ storage, quality

@plan("S4_append_and_read")
def s4(spark, d):
    """Products written by tenant folder and read again."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/products-{uuid.uuid4().hex}"
    append_partitioned(B.products(spark, d), path)
    return spark.read.parquet(path).select("id", "tenant_id", "name", "price")


SQL["S4_append_and_read"] = with_ctes("products") + "SELECT id, tenant_id, name, price FROM products"


@plan("S10_json_rows")
def s10(spark, d):
    return as_json_rows(B.customers(spark, d).select("id", "tenant_id", "segment"))


SQL["S10_json_rows"] = with_ctes("customers") + """
SELECT CAST(to_json({'id': id, 'tenant_id': tenant_id, 'segment': segment}) AS VARCHAR) AS json FROM customers"""


@plan("E6_lines_of_dead_products")
def e6_live(spark, d):
    """References must be to live products: lines of deactivated ones are reported."""
    live = B.products(spark, d).filter(P.is_live())
    return quality.check_foreign_key(B.invoice_lines(spark, d), "invoice_lines", ["product_id"], live, ["id"],
                                     ["invoice_id", "line_no"])


SQL["E6_lines_of_dead_products"] = with_ctes("lines", "products") + """
SELECT 'invoice_lines' AS table_name, 'fk:product_id' AS rule,
       CAST(invoice_id AS VARCHAR) || '|' || CAST(line_no AS VARCHAR) AS row_key, CAST(product_id AS VARCHAR) AS value
FROM lines WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM products WHERE is_active)"""


@plan("E7_missing_theme")
def e7_theme(spark, d):
    return quality.check_not_null(shops(spark, d), "tenants", "theme_color", ["id"])


SQL["E7_missing_theme"] = f"""WITH {_SHOPS}
SELECT 'tenants' AS table_name, 'not_null:theme_color' AS rule, CAST(id AS VARCHAR) AS row_key,
       CAST(NULL AS VARCHAR) AS value FROM shops WHERE theme_color IS NULL"""


@plan("S5_audit_actions")
def s5_events(spark, d):
    """Audit rows per user and action, from the events."""
    return B.audit_events(spark, d).groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("events"))


SQL["S5_audit_actions"] = "SELECT user_id, event_type AS action, count(*) AS events FROM events GROUP BY ALL"
