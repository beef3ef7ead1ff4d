"""DuckDB SQL of every registered plan (same names as ``catalog.PLANS``)."""

from __future__ import annotations

from tillkit.plans.catalog import RANGE_END, RANGE_START
from tillkit.plans.oracle import priced_ctes, with_ctes

SQL: dict[str, str] = {}

_PRICED = ("id, tenant_id, customer_id, subtotal, discount_total, tax_total, grand_total, "
           "payment_method, payment_status, created_at")


def _priced(version: str = "v3") -> str:
    return with_ctes(*priced_ctes(version))


def _range() -> str:
    return (f"created_at >= TIMESTAMP '{RANGE_START} 00:00:00' AND "
            f"created_at <= CAST(DATE '{RANGE_END}' + INTERVAL 1 DAY AS TIMESTAMP)")


# ------------------------------------------------------------------ pricing

SQL["B1_price_invoices_v3"] = _priced("v3") + f"""
SELECT {_PRICED}, paid_amount, balance, invoice_status, bill_discount FROM priced"""

SQL["B1b_price_invoices_v2"] = _priced("v2") + f"""
SELECT {_PRICED}, paid_amount, balance, invoice_status FROM priced"""

SQL["B1a_price_invoices_v1"] = _priced("v1") + f"""
SELECT {_PRICED} FROM priced"""

SQL["B2_invoice_numbers"] = with_ctes("headers") + """
SELECT request_id AS id, tenant_id, created_at,
       'INV-' || CAST(tenant_id AS VARCHAR) || '-' || strftime(created_at, '%Y%m%d') || '-' ||
       lpad(CAST(ROW_NUMBER() OVER (PARTITION BY tenant_id, CAST(created_at AS DATE)
                                     ORDER BY created_at, request_id) AS VARCHAR), 4, '0')
         AS invoice_number
FROM headers"""

SQL["W2_surrogate_keys"] = """
SELECT o_orderkey AS request_id, o_orderdate AS created_at,
       (SELECT max(o_orderkey) FROM orders)
         + ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS id
FROM orders"""

SQL["B3_stock_after_sales"] = with_ctes("products", "lines", "headers") + """
, sold AS (
  SELECT h.tenant_id, l.product_id,
         CASE WHEN count(*) FILTER (WHERE l.quantity IS NULL) > 0 THEN NULL
              ELSE SUM(l.quantity) END AS sold
  FROM lines l JOIN headers h ON h.request_id = l.invoice_id
  GROUP BY h.tenant_id, l.product_id)
SELECT p.id, p.tenant_id, p.name,
       CASE WHEN s.product_id IS NULL THEN p.stock_qty
            ELSE CAST(p.stock_qty - s.sold AS DECIMAL(12,3)) END AS stock_qty
FROM products p LEFT JOIN sold s ON s.tenant_id = p.tenant_id AND s.product_id = p.id"""

SQL["B4_settle_drafts"] = _priced("v3") + """
SELECT id, tenant_id, grand_total,
       CASE WHEN invoice_status = 'Draft' THEN grand_total ELSE paid_amount END AS paid_amount,
       CASE WHEN invoice_status = 'Draft' THEN CAST(0 AS DECIMAL(38,20)) ELSE balance END
         AS balance,
       CASE WHEN invoice_status = 'Draft' THEN 'Paid' ELSE invoice_status END AS invoice_status
FROM priced"""

# ------------------------------------------------------------------ reports

_SUMMARY = """
SELECT tenant_id,
       COALESCE(CAST(SUM(grand_total) AS DECIMAL(38,2)), 0) AS total_revenue,
       COUNT(id) AS total_invoices,
       COALESCE(CAST(SUM(tax_total) AS DECIMAL(38,2)), 0) AS total_tax,
       COALESCE(CAST(SUM(discount_total) AS DECIMAL(38,2)), 0) AS total_discount
FROM priced {where} GROUP BY tenant_id"""

_SUMMARY_ALL = """
, s AS ({inner})
SELECT t.id AS tenant_id,
       COALESCE(s.total_revenue, CAST(0 AS DECIMAL(38,2))) AS total_revenue,
       COALESCE(s.total_invoices, 0) AS total_invoices,
       COALESCE(s.total_tax, CAST(0 AS DECIMAL(38,2))) AS total_tax,
       COALESCE(s.total_discount, CAST(0 AS DECIMAL(38,2))) AS total_discount
FROM tenants t LEFT JOIN s ON s.tenant_id = t.id"""

SQL["R1_sales_summary"] = with_ctes(*priced_ctes("v3"), "tenants") + _SUMMARY_ALL.format(
    inner=_SUMMARY.format(where=""))
SQL["R1_sales_summary_range"] = with_ctes(*priced_ctes("v3"), "tenants") + _SUMMARY_ALL.format(
    inner=_SUMMARY.format(where="WHERE " + _range()))

SQL["R1a_sales_summary_v1"] = _priced() + """
SELECT tenant_id, COUNT(*) AS total_invoices,
       CAST(SUM(grand_total) AS DECIMAL(38,2)) AS total_revenue,
       CAST(SUM(discount_total) AS DECIMAL(38,2)) AS total_discount,
       CAST(SUM(tax_total) AS DECIMAL(38,2)) AS total_tax
FROM priced WHERE payment_status = 'paid' GROUP BY tenant_id"""

_DAILY = """
SELECT tenant_id, CAST(created_at AS DATE) AS sale_date,
       CAST(SUM(grand_total) AS DECIMAL(38,2)) AS total_revenue, COUNT(id) AS total_invoices
FROM priced {where} GROUP BY tenant_id, CAST(created_at AS DATE)
ORDER BY tenant_id, sale_date DESC"""

SQL["R2_daily_sales"] = _priced() + _DAILY.format(where="")
SQL["R2_daily_sales_range"] = _priced() + _DAILY.format(where="WHERE " + _range())

SQL["R2a_daily_sales_v1"] = _priced() + """
SELECT tenant_id, CAST(created_at AS DATE) AS sale_date, COUNT(*) AS total_invoices,
       CAST(SUM(grand_total) AS DECIMAL(38,2)) AS total_revenue
FROM priced WHERE payment_status = 'paid' GROUP BY tenant_id, CAST(created_at AS DATE)"""

SQL["R3_top_products"] = with_ctes(*priced_ctes("v3"), "products") + """
, g AS (
  SELECT i.tenant_id, p.name AS product_name,
         CAST(SUM(l.quantity) AS DECIMAL(38,3)) AS total_qty,
         CAST(SUM(l.quantity * l.unit_price - COALESCE(l.discount, 0)) AS DECIMAL(38,8))
           AS total_revenue
  FROM lines l JOIN priced i ON i.id = l.invoice_id JOIN products p ON p.id = l.product_id
  GROUP BY i.tenant_id, p.name)
SELECT * FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY tenant_id
                                    ORDER BY total_revenue DESC NULLS FIRST, product_name)
              AS INTEGER) AS rank
  FROM g) WHERE rank <= 10"""

SQL["R3a_top_products_v1"] = with_ctes(*priced_ctes("v3"), "products") + """
, g AS (
  SELECT i.tenant_id, l.product_id, p.name AS product_name,
         CAST(SUM(l.quantity) AS DECIMAL(38,3)) AS total_qty,
         CAST(SUM(l.unit_price * l.quantity) AS DECIMAL(38,8)) AS total_revenue
  FROM lines l JOIN priced i ON i.id = l.invoice_id JOIN products p ON p.id = l.product_id
  WHERE i.payment_status = 'paid'
  GROUP BY i.tenant_id, l.product_id, p.name)
SELECT * FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY tenant_id
                                    ORDER BY total_qty DESC NULLS FIRST, product_id)
              AS INTEGER) AS rank
  FROM g) WHERE rank <= 10"""

SQL["R4_payment_methods"] = _priced() + """
SELECT tenant_id, payment_method, COUNT(id) AS total_invoices,
       CAST(SUM(grand_total) AS DECIMAL(38,2)) AS total_revenue
FROM priced GROUP BY tenant_id, payment_method"""

SQL["R4a_payment_methods_v1"] = _priced() + """
SELECT tenant_id, payment_method, COUNT(*) AS total_invoices,
       CAST(SUM(grand_total) AS DECIMAL(38,2)) AS total_revenue
FROM priced WHERE payment_status = 'paid' GROUP BY tenant_id, payment_method"""

# ------------------------------------------------------------ listings, access

SQL["L2_list_products"] = with_ctes("products") + """
SELECT * FROM products WHERE is_active = TRUE ORDER BY tenant_id, id"""

SQL["L3_list_customers"] = with_ctes("customers") + """
SELECT * FROM customers WHERE is_active = TRUE ORDER BY tenant_id, id"""

SQL["L4_list_invoices"] = _priced() + """
SELECT id, tenant_id, customer_id, grand_total, invoice_status, created_at
FROM priced ORDER BY tenant_id, created_at DESC"""

SQL["L10_list_tenant_roles"] = with_ctes("tenant_roles") + """
SELECT * FROM tenant_roles WHERE is_active = TRUE ORDER BY tenant_id, name"""

SQL["J1_login_rows"] = with_ctes("users", "roles") + """
SELECT u.id, u.username, u.full_name, u.role_id, r.name AS role_name, u.tenant_id,
       u.tenant_role_id, u.is_active
FROM users u JOIN roles r ON r.id = u.role_id WHERE u.is_active = TRUE"""

_LIST_USERS = """
SELECT u.id, u.username, u.full_name, u.role_id, r.name AS role_name, u.tenant_id,
       u.tenant_role_id, tr.name AS tenant_role_name, t.name AS tenant_name, t.business_type,
       u.is_active, u.created_at
FROM users u JOIN roles r ON r.id = u.role_id
LEFT JOIN tenant_roles tr ON tr.id = u.tenant_role_id
LEFT JOIN tenants t ON t.id = u.tenant_id
WHERE {where}"""

SQL["J2_list_users_admin_view"] = with_ctes("users", "roles", "tenant_roles", "tenants") + \
    _LIST_USERS.format(where="u.role_id <> 1")
SQL["J2_list_staff_all_tenants"] = with_ctes("users", "roles", "tenant_roles", "tenants") + \
    _LIST_USERS.format(where="u.tenant_id IS NOT NULL AND u.role_id = 3")

SQL["J3_user_menus"] = with_ctes("users", "menus", "role_permissions",
                                 "tenant_role_permissions") + """
, perms AS (
  SELECT u.id AS user_id, p.menu_id, p.can_view, p.can_add, p.can_edit, p.can_delete
  FROM users u JOIN tenant_role_permissions p ON p.tenant_role_id = u.tenant_role_id
  WHERE u.tenant_role_id IS NOT NULL AND p.can_view = TRUE
  UNION ALL
  SELECT u.id, p.menu_id, p.can_view, p.can_add, p.can_edit, p.can_delete
  FROM users u JOIN role_permissions p ON p.role_id = u.role_id
  WHERE u.tenant_role_id IS NULL AND p.can_view = TRUE)
SELECT p.user_id, m.id AS menu_id, m.name AS menu_name, m.route,
       COALESCE(m.icon, 'circle') AS icon, m.parent_id, COALESCE(m.sort_order, 0) AS sort_order,
       p.can_view, p.can_add, p.can_edit, p.can_delete
FROM perms p JOIN menus m ON m.id = p.menu_id WHERE m.is_active = TRUE"""

SQL["J8_user_business_type"] = with_ctes("users", "tenants", "business_types") + """
SELECT u.id AS user_id, u.tenant_id, b.id AS business_type_id, b.name AS business_type_name,
       b.label AS business_type_label
FROM users u LEFT JOIN tenants t ON t.id = u.tenant_id
LEFT JOIN business_types b ON b.name = t.business_type"""

SQL["J11_staff_roles_of_own_tenant"] = with_ctes("users", "tenant_roles") + """
SELECT u.id AS user_id, u.tenant_role_id AS id, u.tenant_id
FROM users u WHERE u.tenant_role_id IS NOT NULL
  AND EXISTS (SELECT 1 FROM tenant_roles r WHERE r.id = u.tenant_role_id
                                            AND r.tenant_id = u.tenant_id)"""

SQL["J13_tenant_role_permission_listing"] = with_ctes("tenant_role_permissions", "tenant_roles",
                                                      "menus") + """
SELECT p.tenant_role_id AS role_id, r.name AS role_name, p.menu_id, m.name AS menu_name, m.route,
       COALESCE(NULLIF(concat_ws(', ', CASE WHEN p.can_view THEN 'View' END,
                                       CASE WHEN p.can_add THEN 'Add' END,
                                       CASE WHEN p.can_edit THEN 'Edit' END,
                                       CASE WHEN p.can_delete THEN 'Delete' END), ''), 'None')
         AS flags
FROM tenant_role_permissions p JOIN tenant_roles r ON r.id = p.tenant_role_id
JOIN menus m ON m.id = p.menu_id"""

SQL["F14_user_branding"] = with_ctes("users", "tenants") + """
SELECT u.id AS user_id, u.tenant_id,
       COALESCE(NULLIF(t.name, ''), 'Billing') AS tenant_name,
       COALESCE(NULLIF(t.theme_color, ''), '#6366F1') AS theme_color
FROM users u LEFT JOIN tenants t ON t.id = u.tenant_id"""

SQL["S5_menu_access_log"] = with_ctes("users") + """
SELECT id AS user_id, tenant_id, 'GET_MENUS' AS action, 'menus' AS resource
FROM users WHERE tenant_id IS NOT NULL"""

SQL["A12_active_users_per_tenant_role"] = with_ctes("users") + """
SELECT tenant_role_id, COUNT(*) AS active_users FROM users
WHERE is_active = TRUE AND tenant_role_id IS NOT NULL GROUP BY tenant_role_id"""

# ----------------------------------------------------------------- maintenance

_PRODUCT_COLS = "id, tenant_id, name, category, brand, price, stock_qty, is_active"
_TRP_COLS = "tenant_role_id, menu_id, can_view, can_add, can_edit, can_delete"

SQL["M1_patch_products"] = with_ctes("products") + """
, changes AS (
  SELECT p_partkey AS id, CAST(p_partkey % 25 AS INTEGER) AS tenant_id,
         CASE WHEN p_size < 5 THEN upper(p_name) END AS name,
         CASE WHEN p_size > 25 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2))
                                         * CAST(1.1 AS DECIMAL(2,1)) AS DECIMAL(12,2)) END AS price
  FROM part)
SELECT p.id, p.tenant_id, COALESCE(c.name, p.name) AS name, p.category, p.brand,
       COALESCE(c.price, p.price) AS price, p.stock_qty, p.is_active
FROM products p LEFT JOIN changes c ON c.id = p.id AND c.tenant_id = p.tenant_id"""

SQL["M2_upsert_tenant_role_permissions"] = with_ctes("tenant_role_permissions") + """
, changes AS (
  SELECT s_suppkey AS tenant_role_id, 5 AS menu_id, s_acctbal > 0 AS can_view,
         FALSE AS can_add, FALSE AS can_edit, FALSE AS can_delete FROM supplier
  UNION ALL
  SELECT s_suppkey, 1, TRUE, TRUE, TRUE, TRUE FROM supplier)
SELECT COALESCE(t.tenant_role_id, c.tenant_role_id) AS tenant_role_id,
       CAST(COALESCE(t.menu_id, c.menu_id) AS INTEGER) AS menu_id,
       CASE WHEN c.tenant_role_id IS NOT NULL THEN c.can_view ELSE t.can_view END AS can_view,
       CASE WHEN c.tenant_role_id IS NOT NULL THEN c.can_add ELSE t.can_add END AS can_add,
       CASE WHEN c.tenant_role_id IS NOT NULL THEN c.can_edit ELSE t.can_edit END AS can_edit,
       CASE WHEN c.tenant_role_id IS NOT NULL THEN c.can_delete ELSE t.can_delete END AS can_delete
FROM tenant_role_permissions t FULL OUTER JOIN changes c
  ON c.tenant_role_id = t.tenant_role_id AND c.menu_id = t.menu_id"""

SQL["M3_insert_ignore_grants"] = with_ctes("tenant_role_permissions") + f"""
, rows_in AS (
  SELECT s_suppkey AS tenant_role_id, 1 AS menu_id, FALSE AS can_view, FALSE AS can_add,
         FALSE AS can_edit, FALSE AS can_delete, 1 AS pos FROM supplier
  UNION ALL SELECT s_suppkey, 7, TRUE, FALSE, FALSE, FALSE, 1 FROM supplier
  UNION ALL SELECT s_suppkey, 7, TRUE, TRUE, TRUE, TRUE, 2 FROM supplier)
, firsts AS (
  SELECT * FROM rows_in
  QUALIFY ROW_NUMBER() OVER (PARTITION BY tenant_role_id, menu_id ORDER BY pos) = 1)
SELECT {_TRP_COLS} FROM tenant_role_permissions
UNION ALL
SELECT f.tenant_role_id, CAST(f.menu_id AS INTEGER), f.can_view, f.can_add, f.can_edit,
       f.can_delete
FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM tenant_role_permissions t
                  WHERE t.tenant_role_id = f.tenant_role_id AND t.menu_id = f.menu_id)"""

SQL["M4_save_tenant_roles"] = with_ctes("tenant_roles") + """
, upd AS (
  SELECT s_suppkey AS id, CAST(s_nationkey AS INTEGER) AS tenant_id, upper(s_name) AS name
  FROM supplier WHERE s_acctbal < 0)
, ins AS (
  SELECT CAST(s_nationkey AS INTEGER) AS tenant_id, s_name || ' Senior' AS name
  FROM supplier WHERE s_acctbal > 9000)
SELECT r.id, r.tenant_id, CASE WHEN u.id IS NOT NULL THEN u.name ELSE r.name END AS name,
       r.is_active
FROM tenant_roles r
LEFT JOIN upd u ON u.id = r.id AND (u.tenant_id IS NULL OR u.tenant_id = r.tenant_id)
UNION ALL
SELECT (SELECT max(id) FROM tenant_roles) + ROW_NUMBER() OVER (ORDER BY tenant_id, name),
       tenant_id, name, TRUE
FROM ins"""

SQL["M5_insert_products_with_defaults"] = with_ctes("products") + f"""
SELECT {_PRODUCT_COLS} FROM products
UNION ALL
SELECT (SELECT max(id) FROM products) + ROW_NUMBER() OVER (ORDER BY p_partkey) AS id,
       CAST((p_partkey + 1) % 25 AS INTEGER) AS tenant_id, p_name AS name,
       'General' AS category, p_brand AS brand, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
       CAST(0 AS DECIMAL(12,3)) AS stock_qty, TRUE AS is_active
FROM part"""

SQL["M6_soft_delete_unsold_products"] = with_ctes("products") + """
SELECT p.id, p.tenant_id,
       CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.id) THEN FALSE
            ELSE p.is_active END AS is_active
FROM products p"""

SQL["M9_cascade_deactivate_users"] = with_ctes("users") + """
SELECT id, tenant_id,
       CASE WHEN tenant_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 4) THEN FALSE
            ELSE is_active END AS is_active
FROM users"""

SQL["M10_toggle_users"] = with_ctes("users") + """
SELECT u.id, u.tenant_id,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN NOT u.is_active ELSE u.is_active END
         AS is_active
FROM users u JOIN customer c ON c.c_custkey = u.id"""

SQL["M11_delete_inactive_users"] = with_ctes("users") + """
SELECT id, tenant_id, role_id FROM users WHERE is_active IS DISTINCT FROM FALSE"""

SQL["M12_replace_role_permissions"] = with_ctes("tenant_role_permissions") + f"""
SELECT {_TRP_COLS} FROM tenant_role_permissions
WHERE tenant_role_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
UNION ALL
SELECT s_suppkey, CAST(unnest([1, 2, 8, 9]) AS INTEGER), TRUE, TRUE, FALSE, FALSE
FROM supplier WHERE s_acctbal < 0"""

SQL["M14_update_billing_grants"] = with_ctes("tenant_role_permissions") + """
SELECT tenant_role_id, menu_id, can_view, can_add,
       CASE WHEN menu_id IN (2, 8, 9) THEN FALSE ELSE can_edit END AS can_edit,
       CASE WHEN menu_id IN (2, 8, 9) THEN FALSE ELSE can_delete END AS can_delete
FROM tenant_role_permissions"""

SQL["M15_products_with_new_columns"] = with_ctes("products") + f"""
SELECT {_PRODUCT_COLS}, CAST(0 AS DECIMAL(12,2)) AS discount, 'percent' AS discount_type,
       CAST(0 AS DECIMAL(5,2)) AS tax_percent, '{{}}' AS variants
FROM products"""

# --------------------------------------------------------- quality, aggregates

_HDR_INV = "(SELECT request_id AS id, * EXCLUDE (request_id) FROM headers) inv"

SQL["E2_invalid_payment_method"] = with_ctes("headers") + f"""
SELECT 'invoices' AS table_name, 'check:payment_method' AS rule,
       COALESCE(CAST(id AS VARCHAR), 'NULL') AS row_key, payment_method AS value
FROM {_HDR_INV}
WHERE payment_method IS NOT NULL AND payment_method NOT IN ('cash', 'upi', 'card')"""

_E5 = """
SELECT 'invoice_lines' AS table_name, 'unique:invoice_id,line_no' AS rule,
       COALESCE(CAST(invoice_id AS VARCHAR), 'NULL') || '|' ||
       COALESCE(CAST(line_no AS VARCHAR), 'NULL') AS row_key,
       CAST(COUNT(*) AS VARCHAR) AS value
FROM lines WHERE invoice_id IS NOT NULL AND line_no IS NOT NULL
GROUP BY invoice_id, line_no HAVING COUNT(*) > 1"""

SQL["E5_duplicate_invoice_lines"] = with_ctes("lines") + _E5

_E6 = """
SELECT 'invoice_lines' AS table_name, 'fk:product_id' AS rule,
       COALESCE(CAST(invoice_id AS VARCHAR), 'NULL') || '|' ||
       COALESCE(CAST(line_no AS VARCHAR), 'NULL') AS row_key,
       COALESCE(CAST(product_id AS VARCHAR), 'NULL') AS value
FROM lines l WHERE product_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM products p WHERE p.id = l.product_id)"""

SQL["E6_orphan_line_products"] = with_ctes("lines", "products") + _E6

SQL["E7_missing_product_price"] = with_ctes("products") + """
SELECT 'products' AS table_name, 'not_null:price' AS rule,
       COALESCE(CAST(id AS VARCHAR), 'NULL') AS row_key, CAST(NULL AS VARCHAR) AS value
FROM products WHERE price IS NULL"""

SQL["E_quality_summary"] = with_ctes("headers", "lines", "products", "customers") + f"""
, v AS (
  SELECT 'invoices' AS table_name, 'check:payment_method' AS rule FROM {_HDR_INV}
  WHERE payment_method IS NOT NULL AND payment_method NOT IN ('cash', 'upi', 'card')
  UNION ALL
  SELECT 'invoices', 'check:payment_status' FROM {_HDR_INV}
  WHERE payment_status IS NOT NULL AND payment_status NOT IN ('paid', 'pending', 'cancelled')
  UNION ALL SELECT table_name, rule FROM ({_E5})
  UNION ALL SELECT table_name, rule FROM ({_E6})
  UNION ALL
  SELECT 'invoices', 'fk:customer_id' FROM {_HDR_INV}
  WHERE customer_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM customers c WHERE c.id = inv.customer_id)
  UNION ALL
  SELECT 'invoices', 'not_null:tenant_id' FROM {_HDR_INV} WHERE tenant_id IS NULL)
SELECT table_name, rule, COUNT(*) AS violations FROM v GROUP BY table_name, rule"""

SQL["A10_products_per_business_type"] = with_ctes("products", "tenants") + """
SELECT t.business_type AS label, CAST(COUNT(*) AS BIGINT) AS row_count
FROM products p JOIN tenants t ON t.id = p.tenant_id
WHERE p.is_active = TRUE GROUP BY t.business_type"""

SQL["A11_rows_per_tenant"] = with_ctes("customers", "products", "headers") + """
, c AS (SELECT tenant_id, COUNT(*) AS n FROM customers GROUP BY tenant_id)
, p AS (SELECT tenant_id, COUNT(*) AS n FROM products GROUP BY tenant_id)
, i AS (SELECT tenant_id, COUNT(*) AS n FROM headers GROUP BY tenant_id)
SELECT COALESCE(c.tenant_id, p.tenant_id, i.tenant_id) AS tenant_id,
       COALESCE(c.n, 0) AS customers_count, COALESCE(p.n, 0) AS products_count,
       COALESCE(i.n, 0) AS invoices_count
FROM c FULL OUTER JOIN p ON p.tenant_id = c.tenant_id
FULL OUTER JOIN i ON i.tenant_id = COALESCE(c.tenant_id, p.tenant_id)"""

SQL["A13_duplicate_product_names"] = with_ctes("products") + """
SELECT name, COUNT(*) AS copies, MIN(id) AS keep_id
FROM products GROUP BY name HAVING COUNT(*) > 1"""

# ------------------------------------------------------------------ streaming

SQL["T1_daily_sales_stream"] = _priced() + """
SELECT tenant_id, CAST(created_at AS DATE) AS sale_date,
       CAST(SUM(grand_total) AS DECIMAL(38,2)) AS total_revenue, COUNT(id) AS total_invoices
FROM priced GROUP BY tenant_id, CAST(created_at AS DATE)"""

SQL["T2_invoice_posting_stream"] = SQL["B1_price_invoices_v3"]

# ------------------------------------------------ request-shaped, provisioning

from tillkit.plans import requests as _requests  # noqa: E402

SQL.update(_requests.SQL)
SQL["R3_top_products_nested"] = SQL["R3_top_products"]

from tillkit.plans import masters as _masters  # noqa: E402
from tillkit.plans import stored as _stored  # noqa: E402

SQL.update(_stored.SQL)
SQL.update(_masters.SQL)
SQL["R1_summary_per_row"] = SQL["R1_sales_summary"]
SQL["R2_daily_per_row"] = SQL["R2_daily_sales"]
SQL["R3_top_products_per_row"] = f"SELECT * EXCLUDE (rank) FROM ({SQL['R3_top_products']})"
SQL["R4_methods_per_row"] = SQL["R4_payment_methods"]


def _calls() -> str:
    from tillkit.sources import seeds

    of_three = {
        "list_products": "L2_list_products", "list_customers": "L3_list_customers",
        "list_tenant_roles": "L10_list_tenant_roles"}
    rows = {n: f"({SQL[q]}) x WHERE tenant_id = 3" for n, q in of_three.items()}
    rows |= {
        "get_invoice": f"({with_ctes('headers')} SELECT * FROM headers) x WHERE request_id = 11 AND tenant_id = 3",
        "get_menus": f"({SQL['J3_user_menus']}) x WHERE user_id = 11",
        "list_menus_for_tenant_role": f"({SQL['J4_role_menu_configs']}) x WHERE tenant_role_id = 3",
        "get_tenant_features": f"({with_ctes('tenant_features')} SELECT * FROM tenant_features) x WHERE tenant_id = 3",
        "list_users": f"({with_ctes('users')} SELECT * FROM users) x WHERE tenant_id = 3",
        "list_tenants": "nation", "list_business_types": f"range({len(seeds.BUSINESS_TYPES)})",
        "list_uom": f"range({len(seeds.UOMS)})", "list_hsn": f"range({len(seeds.HSNS)})",
        "list_categories": f"range({sum(len(x) for x in seeds.CATEGORY_TEMPLATES.values())})"}
    return " UNION ALL ".join(f"SELECT '{n}' AS function, count(*) AS rows FROM {r}" for n, r in sorted(rows.items()))


SQL["Function_calls"] = _calls()

from tillkit.plans.catalog import PLANS as _PLANS  # noqa: E402

#: Names of all registered plans of the billing tables.
PLAN_NAMES = tuple(_PLANS)
