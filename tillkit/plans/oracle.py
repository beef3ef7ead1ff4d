"""DuckDB SQL for every registered plan (the correctness oracle).

The tables ``region nation customer supplier part orders lineitem events``
are views over the same parquet files. The binding of ``tillkit.sources.binding``
is written again here as CTEs, independently of the Spark code, with the same
decimal types so that both engines compute exact and equal values.
"""

from __future__ import annotations

from tillkit.sources import binding as B
from tillkit.sources import seeds

# ---------------------------------------------------------------- bindings

_PM = """CASE WHEN substr(o.o_orderpriority, 1, 1) IN ('1', '2') THEN 'cash'
              WHEN substr(o.o_orderpriority, 1, 1) = '3' THEN 'upi'
              WHEN substr(o.o_orderpriority, 1, 1) = '4' THEN 'card'
              WHEN substr(o.o_orderpriority, 1, 1) = '5' THEN 'split' END"""

CTE = {
    "tenants": f"""
tenants AS (
  SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name,
         CASE n_nationkey % 5 {' '.join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(seeds.BUSINESS_TYPES_V1))} END
           AS business_type,
         n_nationkey % {B.INACTIVE_TENANT_MOD} <> {B.INACTIVE_TENANT_REM} AS is_active,
         CASE WHEN n_regionkey = 0 THEN NULL WHEN n_regionkey = 1 THEN ''
              ELSE '{B.THEME_COLOR}' END AS theme_color
  FROM nation)""",
    "customers": """
customers AS (
  SELECT c_custkey AS id, CAST(c_nationkey AS INTEGER) AS tenant_id, c_name AS name,
         c_mktsegment AS segment, c_acctbal >= 0 AS is_active
  FROM customer)""",
    "products": f"""
products AS (
  SELECT p_partkey AS id, CAST(p_partkey % {B.TENANT_COUNT} AS INTEGER) AS tenant_id,
         p_name AS name, p_type AS category, p_brand AS brand,
         CAST(p_retailprice AS DECIMAL(12,2)) AS price,
         CAST(p_size * 100 AS DECIMAL(12,3)) AS stock_qty,
         p_size % 10 <> 0 AS is_active
  FROM part)""",
    "lines": """
lines AS (
  SELECT l.l_orderkey AS invoice_id, l.l_linenumber AS line_no, l.l_partkey AS product_id,
         CAST(l.l_quantity AS DECIMAL(13,4)) AS quantity,
         CAST(l.l_extendedprice AS DECIMAL(14,4)) AS unit_price,
         CAST(CAST(l.l_discount AS DECIMAL(5,2)) * 100 AS DECIMAL(14,4)) AS discount,
         'percent' AS discount_type,
         CAST(CAST(l.l_tax AS DECIMAL(5,2)) * 100 AS DECIMAL(7,4)) AS tax_percent
  FROM lineitem l)""",
    "headers": f"""
headers AS (
  SELECT o.o_orderkey AS request_id, CAST(o.o_custkey % {B.TENANT_COUNT} AS INTEGER) AS tenant_id,
         o.o_custkey AS customer_id,
         {_PM} AS payment_method,
         CASE o.o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending'
                              WHEN 'P' THEN 'cancelled' END AS payment_status,
         CASE o.o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Draft'
                              WHEN 'P' THEN 'Cancelled' END AS invoice_status,
         CAST(o.o_orderkey % 7 AS DECIMAL(12,2)) AS paid_amount,
         CAST(o.o_orderkey % 7 AS DECIMAL(38,20)) AS meta_bill_discount,
         o.o_orderdate AS created_at
  FROM orders o)""",
    "users": f"""
users AS (
  SELECT c_custkey AS id, c_name AS username, c_name AS full_name,
         CAST(c_custkey % 3 + 1 AS INTEGER) AS role_id,
         CASE WHEN c_custkey % 3 + 1 = 1 THEN NULL ELSE CAST(c_nationkey AS INTEGER) END
           AS tenant_id,
         CASE WHEN c_custkey % 3 + 1 = 3 AND c_custkey % 2 = 0
              THEN c_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) END AS tenant_role_id,
         c_acctbal >= 0 AS is_active,
         CAST(DATE '{B.USER_EPOCH}' + CAST(c_custkey % {B.USER_DAYS} AS INTEGER) AS DATE)
           AS created_at
  FROM customer)""",
    "tenant_roles": """
tenant_roles AS (
  SELECT s_suppkey AS id, CAST(s_nationkey AS INTEGER) AS tenant_id, s_name AS name,
         s_acctbal >= 0 AS is_active
  FROM supplier)""",
}


def _values(rows, cols) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ",\n    ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES\n    {body}) AS t({', '.join(cols)})"


def _grant_rows():
    rows = []
    for role_id, routes, v, a, e, d in seeds.ROLE_GRANTS:
        for mid, _n, route, *_ in seeds.MENUS:
            if routes is None or route in routes:
                rows.append((role_id, mid, v, a, e, d))
    return rows


CTE["roles"] = f"""
roles AS (SELECT CAST(id AS INTEGER) AS id, name FROM {_values(seeds.ROLES, ['id', 'name'])})"""
CTE["menus"] = f"""
menus AS (
  SELECT CAST(id AS INTEGER) AS id, name, route, icon, CAST(parent_id AS INTEGER) AS parent_id,
         CAST(sort_order AS INTEGER) AS sort_order, TRUE AS is_active
  FROM {_values(seeds.MENUS, ['id', 'name', 'route', 'icon', 'parent_id', 'sort_order'])})"""
CTE["role_permissions"] = f"""
role_permissions AS (
  SELECT CAST(role_id AS INTEGER) AS role_id, CAST(menu_id AS INTEGER) AS menu_id,
         can_view, can_add, can_edit, can_delete
  FROM {_values(_grant_rows(), ['role_id', 'menu_id', 'can_view', 'can_add', 'can_edit', 'can_delete'])})"""
CTE["tenant_role_permissions"] = f"""
tenant_role_permissions AS (
  SELECT s.s_suppkey AS tenant_role_id, g.menu_id, g.can_view, g.can_add, g.can_edit, g.can_delete
  FROM supplier s JOIN role_permissions g ON g.role_id = CAST(s.s_suppkey % 3 + 1 AS INTEGER)
  WHERE g.menu_id NOT IN ({', '.join(str(m[0]) for m in seeds.MENUS if m[2] in seeds.SUPER_ADMIN_ONLY_ROUTES)}))"""
CTE["features"] = f"""
features AS (SELECT * FROM {_values(seeds.FEATURES_BY_BUSINESS_TYPE, ['business_type', 'feature_key', 'enabled'])})"""
CTE["tenant_features"] = """
tenant_features AS (
  SELECT t.id AS tenant_id, f.feature_key, f.enabled
  FROM tenants t JOIN features f ON f.business_type = t.business_type)"""
CTE["business_types"] = f"""
business_types AS (
  SELECT CAST(id AS INTEGER) AS id, name, label, description, TRUE AS is_active
  FROM {_values([b[:4] for b in seeds.BUSINESS_TYPES], ['id', 'name', 'label', 'description'])})"""

_DEPS = {
    "tenant_features": ["tenants", "features"],
    "tenant_role_permissions": ["role_permissions"],
}

# ------------------------------------------------------------------ pricing

_HUNDREDTH = "CAST(0.01 AS DECIMAL(2,2))"


def _line_amounts(version: str) -> str:
    lt = "CAST(unit_price * quantity AS DECIMAL(24,8))"
    amount = "CAST(COALESCE(discount, 0) AS DECIMAL(38,14))"
    default = {"v2": "percent", "v3": "fixed"}.get(version)
    if default is None:
        disc = amount
    else:
        pct = (f"CAST({lt} * CAST(COALESCE(discount, 0) * {_HUNDREDTH} AS DECIMAL(13,6)) "
               "AS DECIMAL(38,14))")
        disc = (f"CASE WHEN COALESCE(discount_type, '{default}') = 'percent' "
                f"THEN {pct} ELSE {amount} END")
    return f"""
line_amounts AS (
  SELECT invoice_id, product_id, quantity, lt, disc,
         CAST(CAST(CAST(lt AS DECIMAL(30,14)) - CAST(disc AS DECIMAL(30,14)) AS DECIMAL(30,14))
              * CAST(COALESCE(tax_percent, 0) * {_HUNDREDTH} AS DECIMAL(7,6)) AS DECIMAL(38,20)) AS tax
  FROM (SELECT *, {disc} AS disc FROM (SELECT *, {lt} AS lt FROM lines) a) b)"""


def _strict(c: str) -> str:
    return (f"CAST(CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > 0 THEN NULL "
            f"ELSE SUM({c}) END AS DECIMAL(38,20))")


def priced_ctes(version: str = "v3") -> list[str]:
    """CTE names (in order) and text producing ``priced`` (the invoices table)."""
    bill = "h.meta_bill_discount" if version == "v3" else "CAST(0 AS DECIMAL(38,20))"
    zero = "CAST(0 AS DECIMAL(38,20))"
    grand = f"(s.sub - s.disc - {bill} + s.tax)"
    if version == "v3":
        grand = f"GREATEST({zero}, {grand})"
    totals = f"""
totals AS (
  SELECT invoice_id, {_strict('lt')} AS sub, {_strict('disc')} AS disc, {_strict('tax')} AS tax
  FROM line_amounts GROUP BY invoice_id)"""
    sums = f"""
sums AS (
  SELECT h.*, CASE WHEN t.invoice_id IS NULL THEN {zero} ELSE t.sub END AS sub,
              CASE WHEN t.invoice_id IS NULL THEN {zero} ELSE t.disc END AS disc,
              CASE WHEN t.invoice_id IS NULL THEN {zero} ELSE t.tax END AS tax
  FROM headers h LEFT JOIN totals t ON t.invoice_id = h.request_id)"""
    priced = f"""
priced AS (
  SELECT h.request_id AS id, h.tenant_id, h.customer_id,
         CAST(s.sub AS DECIMAL(12,2)) AS subtotal,
         CAST(s.disc + {bill} AS DECIMAL(12,2)) AS discount_total,
         CAST(s.tax AS DECIMAL(12,2)) AS tax_total,
         CAST({grand} AS DECIMAL(12,2)) AS grand_total,
         h.payment_method, h.payment_status, h.paid_amount,
         CAST({grand} - h.paid_amount AS DECIMAL(38,20)) AS balance,
         h.invoice_status, {bill} AS bill_discount, h.created_at
  FROM sums s JOIN headers h ON h.request_id = s.request_id)"""
    return ["lines", "headers", _line_amounts(version), totals, sums, priced]


def with_ctes(*parts: str) -> str:
    """``WITH`` clause from CTE names (bindings) or literal CTE texts, deps first."""
    seen, out = set(), []

    def add(p):
        if p in CTE:
            for d in _DEPS.get(p, []):
                add(d)
            if p not in seen:
                seen.add(p)
                out.append(CTE[p].strip())
        else:
            out.append(p.strip())
    for p in parts:
        add(p)
    return "WITH " + ",\n".join(out) + "\n"
