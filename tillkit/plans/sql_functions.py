"""The table-valued procedures as Spark SQL table functions.

``register`` publishes the billing tables as temporary views and creates
temporary SQL table functions, so a SQL user can write::

    SELECT * FROM report_daily_sales(3, DATE'1996-01-01', DATE'1996-12-31');
    SELECT * FROM report_top_products(p_tenant_id => 3);

The ``tenant_*`` functions take a tenant alone and may be called for each row of
a table; Spark turns such calls into joins (no nested loop)::

    SELECT t.id, r.* FROM tenants t, LATERAL tenant_top_products(t.id) r;

Reports are generated from the measures that the DataFrame reports use
(``operators.reports``); listings return the columns of the published table,
whatever they are. Functions are inlined into the calling query, so tests of
absent arguments fold away and the remaining filters reach the parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tillkit.functions import money as M
from tillkit.operators import reports


@dataclass(frozen=True)
class Argument:
    """A parameter and the condition it stands for; optional ones may be NULL."""

    name: str
    kind: str
    condition: str
    optional: bool = True

    def declared(self) -> str:
        return f"{self.name} {self.kind}" + (" DEFAULT NULL" if self.optional else "")

    def applied(self) -> str:
        return f"({self.name} IS NULL OR {self.condition})" if self.optional else self.condition


TENANT = Argument("p_tenant_id", "INT", "tenant_id = p_tenant_id", optional=False)
#: Masters: templates for no tenant, else the tenant's own.
STRICT = Argument("p_tenant_id", "INT", "tenant_id <=> p_tenant_id", optional=False)
#: The end date is inclusive up to the next midnight.
SCOPE = (TENANT,
         Argument("p_start_date", "DATE", "created_at >= p_start_date"),
         Argument("p_end_date", "DATE", "created_at <= p_end_date + INTERVAL 1 DAY"),
         Argument("p_customer_id", "BIGINT", "customer_id = p_customer_id"))


def _function(name: str, arguments, returns: str, body: str) -> str:
    declared = ", ".join(a.declared() for a in arguments)
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS TABLE ({returns}) RETURN {body}"


def _where(arguments, *more: str) -> str:
    tests = [*(a.applied() for a in arguments), *more]
    return f" WHERE {' AND '.join(tests)}" if tests else ""


def _invoice_report(name: str, measures, group=None, order: str = "", zero: bool = False,
                    arguments=SCOPE, more: tuple[str, ...] = ()) -> str:
    """A report over invoices: ``group`` is (name, type, expression) or None."""
    columns, returns = [], []
    if group:
        columns.append(f"{group[2]} AS {group[0]}")
        returns.append(f"{group[0]} {group[1]}")
    for m in measures:
        sql, kind = reports.MEASURES[m]
        value = f"CAST({sql} AS {kind.simpleString()})"
        columns.append(f"COALESCE({value}, 0) AS {m}" if zero else f"{value} AS {m}")
        returns.append(f"{m} {kind.simpleString()}")
    body = f"SELECT {', '.join(columns)} FROM invoices{_where(arguments, *more)}"
    body += f" GROUP BY {group[2]}" if group else ""
    return _function(name, arguments, ", ".join(returns), body + (f" ORDER BY {order}" if order else ""))


def _tenant_top_products() -> str:
    """As ``report_top_products``, with the tenant's test where a call per row can be turned into a join."""
    qty, revenue = M.QTY_SUM.simpleString(), M.REVENUE_SUM.simpleString()
    sold = (f"SELECT i.tenant_id, product_id, sum(quantity) AS q, sum({reports.NET_REVENUE}) AS r FROM invoice_lines "
            "JOIN (SELECT id, tenant_id FROM invoices) i ON i.id = invoice_id GROUP BY i.tenant_id, product_id")
    return _function(
        "tenant_top_products", (TENANT,), f"product_name STRING, total_qty {qty}, total_revenue {revenue}",
        f"SELECT name AS product_name, CAST(sum(q) AS {qty}) AS total_qty, CAST(sum(r) AS {revenue}) AS total_revenue "
        f"FROM ({sold}) s JOIN products ON products.id = product_id WHERE s.tenant_id = p_tenant_id GROUP BY name "
        f"ORDER BY total_revenue DESC NULLS FIRST, product_name LIMIT {reports.TOP_K}")


def _top_products() -> str:
    qty, revenue = M.QTY_SUM.simpleString(), M.REVENUE_SUM.simpleString()
    sold = (f"SELECT product_id, sum(quantity) AS q, sum({reports.NET_REVENUE}) AS r FROM invoice_lines "
            f"LEFT SEMI JOIN (SELECT id FROM invoices{_where(SCOPE)}) i ON i.id = invoice_id GROUP BY product_id")
    return _function(
        "report_top_products", SCOPE, f"product_name STRING, total_qty {qty}, total_revenue {revenue}",
        f"SELECT name AS product_name, CAST(sum(q) AS {qty}) AS total_qty, CAST(sum(r) AS {revenue}) AS total_revenue "
        f"FROM ({sold}) s JOIN products ON products.id = product_id GROUP BY name "
        f"ORDER BY total_revenue DESC NULLS FIRST, product_name LIMIT {reports.TOP_K}")


def _listing(name: str, view: str, frame: DataFrame, arguments=(), live: bool = False, order: str = "id") -> str:
    """Rows of a view, with all of its columns."""
    returns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    columns = ", ".join(f"`{c}`" for c in frame.columns)
    body = f"SELECT {columns} FROM {view}{_where(arguments, *(['is_active = TRUE'] if live else []))}"
    return _function(name, arguments, returns, f"{body} ORDER BY {order}" if order else body)


def definitions(frames: dict[str, DataFrame]) -> dict[str, str]:
    """The functions that the given tables allow, as SQL by name."""
    count = ("total_revenue", "total_invoices")
    out = {
        "report_sales_summary": _invoice_report(
            "report_sales_summary", (*count, "total_tax", "total_discount"), zero=True),
        "report_daily_sales": _invoice_report(
            "report_daily_sales", count, ("sale_date", "DATE", reports.SALE_DAY), "sale_date DESC NULLS FIRST"),
        "report_payment_methods": _invoice_report(
            "report_payment_methods", count[::-1], ("payment_method", "STRING", "payment_method"),
            "total_revenue DESC NULLS FIRST"),
        "report_top_products": _top_products(),
        "tenant_top_products": _tenant_top_products(),
    }
    day, method = ("sale_date", "DATE", reports.SALE_DAY), ("payment_method", "STRING", "payment_method")
    totals = (*count, "total_tax", "total_discount")
    paid = ("payment_status = 'paid'",)
    for name, measures, group, zero, more in (
            ("tenant_sales_summary", totals, None, True, ()), ("tenant_daily_sales", count, day, False, ()),
            ("tenant_payment_methods", count[::-1], method, False, ()),
            # the earlier forms: paid invoices only, NULL sums when there are none
            ("report_sales_summary_v1", totals, None, False, paid), ("report_daily_sales_v1", count, day, False, paid),
            ("report_payment_methods_v1", count, method, False, paid)):
        out[name] = _invoice_report(name, measures, group, zero=zero, arguments=(TENANT,), more=more)
    invoice = (Argument("p_invoice_id", "BIGINT", "id = p_invoice_id", optional=False), TENANT)
    listings = {
        "list_products": ("products", (TENANT,), True, "id"),
        "list_customers": ("customers", (TENANT,), True, "id"),
        "list_invoices": ("invoices", (TENANT,), False, "created_at DESC NULLS FIRST, id"),
        "get_invoice": ("invoices", invoice, False, ""),
        "list_tenants": ("tenants", (), False, "id"),
        "list_users": ("users", (TENANT,), False, "id"),
        "list_tenant_roles": ("tenant_roles", (TENANT,), True, "name"),
        "list_business_types": ("business_types", (), True, "label"),
        "list_uom": ("uoms", (STRICT,), True, "name"),
        "list_hsn": ("hsns", (STRICT,), True, "hsn_code"),
        "list_categories": ("categories", (STRICT,), True, "parent_id NULLS FIRST, name"),
        "get_tenant_features": ("tenant_features", (TENANT,), False, ""),
        "list_tables": ("restaurant_tables", (TENANT,), False, "id"),
        "get_menus": ("user_menus", (Argument("p_user_id", "BIGINT", "user_id = p_user_id", optional=False),), False, ""),
        "list_menus_for_tenant_role": (
            "role_menus", (Argument("p_role_id", "BIGINT", "tenant_role_id = p_role_id", optional=False),), False, ""),
    }
    for name, (view, arguments, live, order) in listings.items():
        if view in frames:
            out[name] = _listing(name, view, frames[view], arguments, live, order)
    return out


def register(spark: SparkSession, invoices: DataFrame, lines: DataFrame, products: DataFrame,
             customers: DataFrame, **more: DataFrame) -> list[str]:
    """Create views and the functions over them; returns the function names.

    ``more`` may hold ``tenants``, ``users``, ``tenant_roles``, ``business_types``,
    ``uoms``, ``hsns``, ``categories``, ``tenant_features``, ``restaurant_tables``,
    ``user_menus`` (``access.user_menus``) and ``role_menus``
    (``access.tenant_role_menu_configs``).
    """
    frames = {"invoices": invoices, "invoice_lines": lines, "products": products, "customers": customers, **more}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    made = definitions(frames)
    for ddl in made.values():
        spark.sql(ddl)
    return list(made)
