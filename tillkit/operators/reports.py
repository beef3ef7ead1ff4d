"""Sales reports R1-R4 (v2 and the older v1 forms), per tenant or all tenants.

Every report takes ``tenant_id``; ``tenant_id=None`` is the all-tenants form,
which adds ``tenant_id`` to the grouping (top-10 becomes a per-tenant rank).
Filters are literal predicates, so they reach the parquet scan; every
aggregate is algebraic, so Spark pre-aggregates on the map side and a large
tenant does not skew the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillkit.functions import money as M
from tillkit.functions import predicates as P
from tillkit.functions.ordering import pg_desc

TOP_K = 10  # fixed limit of the top-products report

#: Measures over invoices, as SQL: the DataFrame reports and the SQL table
#: functions (``plans.sql_functions``) both read them from here.
MEASURES = {
    "total_revenue": ("sum(grand_total)", M.MONEY_SUM),
    "total_invoices": ("count(id)", T.LongType()),
    "total_tax": ("sum(tax_total)", M.MONEY_SUM),
    "total_discount": ("sum(discount_total)", M.MONEY_SUM),
}
SALE_DAY = "to_date(created_at)"
NET_REVENUE = "quantity * unit_price - coalesce(discount, 0)"


def measures(*names: str, zero: bool = False) -> list[Column]:
    """Aggregates by name; ``zero`` gives 0 instead of NULL when nothing matches."""
    out = []
    for n in names:
        sql, kind = MEASURES[n]
        c = F.expr(sql).cast(kind)
        out.append((F.coalesce(c, F.lit(0).cast(kind)) if zero else c).alias(n))
    return out


def _scope(invoices: DataFrame, tenant_id, start=None, end=None, customer_id=None,
           paid_only: bool = False) -> DataFrame:
    preds = [
        P.tenant_is(tenant_id) if tenant_id is not None else None,
        P.created_between(start, end),
        P.optional_eq("customer_id", customer_id),
        P.status_is("paid") if paid_only else None,
    ]
    if all(p is None for p in preds):
        return invoices
    return invoices.filter(P.all_of(*preds))


def _keys(tenant_id, *more) -> list:
    return ([] if tenant_id is not None else ["tenant_id"]) + list(more)


def _msum(c: str) -> Column:
    return F.sum(c).cast(M.MONEY_SUM)


def sales_summary(invoices: DataFrame, tenant_id=None, start=None, end=None,
                  customer_id=None, tenants: DataFrame | None = None) -> DataFrame:
    """R1 (v2): revenue, count, tax, discount; zeros when nothing matches.

    In the all-tenants form, passing ``tenants`` (a frame with ``id``) adds a
    zero row for every tenant without matching invoices, as the per-tenant
    procedure returns one.
    """
    df = _scope(invoices, tenant_id, start, end, customer_id)
    aggs = measures("total_revenue", "total_invoices", "total_tax", "total_discount", zero=True)
    keys = _keys(tenant_id)
    if not keys:
        return df.agg(*aggs)
    out = df.groupBy(*keys).agg(*aggs)
    if tenants is None:
        return out
    every = tenants.select(F.col("id").alias("tenant_id"))
    j = every.join(out, "tenant_id", "left")
    return j.select("tenant_id",
                    *[F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c)
                      for c, t in out.dtypes if c != "tenant_id"])


def sales_summary_v1(invoices: DataFrame, tenant_id=None) -> DataFrame:
    """Paid invoices only; sums are NULL when nothing matches."""
    df = _scope(invoices, tenant_id, paid_only=True)
    aggs = [F.count(F.lit(1)).alias("total_invoices"), _msum("grand_total").alias("total_revenue"),
            _msum("discount_total").alias("total_discount"), _msum("tax_total").alias("total_tax")]
    keys = _keys(tenant_id)
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def daily_sales(invoices: DataFrame, tenant_id=None, start=None, end=None,
                customer_id=None) -> DataFrame:
    """R2 (v2): revenue and count per day, newest day first."""
    df = _scope(invoices, tenant_id, start, end, customer_id)
    keys = _keys(tenant_id)
    out = (df.groupBy(*keys, F.expr(SALE_DAY).alias("sale_date"))
             .agg(*measures("total_revenue", "total_invoices")))
    return out.orderBy(*keys, pg_desc("sale_date"))


def daily_sales_v1(invoices: DataFrame, tenant_id=None) -> DataFrame:
    """Paid invoices only."""
    df = _scope(invoices, tenant_id, paid_only=True)
    keys = _keys(tenant_id)
    out = (df.groupBy(*keys, F.to_date("created_at").alias("sale_date"))
             .agg(F.count(F.lit(1)).alias("total_invoices"),
                  _msum("grand_total").alias("total_revenue")))
    return out.orderBy(*keys, pg_desc("sale_date"))


def payment_methods(invoices: DataFrame, tenant_id=None, start=None, end=None,
                    customer_id=None) -> DataFrame:
    """R4 (v2): count and revenue per payment method, revenue descending."""
    df = _scope(invoices, tenant_id, start, end, customer_id)
    keys = _keys(tenant_id)
    out = (df.groupBy(*keys, "payment_method")
             .agg(*measures("total_invoices", "total_revenue")))
    return out.orderBy(*keys, pg_desc("total_revenue"), "payment_method")


def payment_methods_v1(invoices: DataFrame, tenant_id=None) -> DataFrame:
    """Paid invoices only, unordered."""
    df = _scope(invoices, tenant_id, paid_only=True)
    keys = _keys(tenant_id)
    return (df.groupBy(*keys, "payment_method")
              .agg(F.count(F.lit(1)).alias("total_invoices"),
                   _msum("grand_total").alias("total_revenue")))


def _top(df: DataFrame, tenant_id, order: list[Column], k: int) -> DataFrame:
    """Top-k overall (TakeOrderedAndProject) or per tenant.

    The per-tenant form is ``row_number() <= k``; Spark plans it with a
    partial WindowGroupLimit before the shuffle, so each map task forwards at
    most k rows per tenant.
    """
    if tenant_id is not None:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy("tenant_id").orderBy(*order)
    return (df.withColumn("rank", F.row_number().over(w))
              .filter(F.col("rank") <= k))


def _sold_by_product(invoices: DataFrame, lines: DataFrame, tenant_id, line_key: str,
                     revenue, start=None, end=None, customer_id=None,
                     paid_only: bool = False) -> DataFrame:
    """Quantity and revenue per (tenant, product id) of the invoices in scope.

    Summed *before* the product look-up: sums are decomposable and exact in
    decimal, so the product join sees one row per (tenant, product) instead
    of one per line, and a hot product cannot skew it.
    """
    inv = _scope(invoices, tenant_id, start, end, customer_id, paid_only).select(
        F.col("id").alias("_iid"), "tenant_id")
    ln = lines.select(F.col(line_key).alias("_lid"), "product_id", "quantity", "unit_price",
                      *(["discount"] if "discount" in lines.columns else []))
    ex = ln.join(inv, ln["_lid"] == inv["_iid"], "inner")
    return ex.groupBy("tenant_id", "product_id").agg(
        F.sum("quantity").alias("_qty"), F.sum(revenue).alias("_rev"))


def _with_names(sold: DataFrame, products: DataFrame) -> DataFrame:
    prod = products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"))
    return sold.join(prod, sold["product_id"] == prod["_pid"], "inner")


def top_products(invoices: DataFrame, lines: DataFrame, products: DataFrame, tenant_id=None,
                 start=None, end=None, customer_id=None, k: int = TOP_K,
                 line_key: str = "invoice_id") -> DataFrame:
    """R3 (v2): top products by revenue net of the raw ``discount`` number.

    Kept as in the reference: ``discount`` is subtracted as an amount even for
    percent lines (N9); products join by id with no tenant test and group by
    **name**, merging same-named products (N10). Ties break on name (N12).
    """
    net = F.expr(NET_REVENUE)
    sold = _sold_by_product(invoices, lines, tenant_id, line_key, net, start, end, customer_id)
    keys = _keys(tenant_id, "product_name")
    g = _with_names(sold, products).groupBy(*keys).agg(
        F.sum("_qty").cast(M.QTY_SUM).alias("total_qty"),
        F.sum("_rev").cast(M.REVENUE_SUM).alias("total_revenue"))
    return _top(g, tenant_id, [pg_desc("total_revenue"), F.col("product_name")], k)


def top_products_v1(invoices: DataFrame, lines: DataFrame, products: DataFrame, tenant_id=None,
                    k: int = TOP_K, line_key: str = "invoice_id") -> DataFrame:
    """Paid only, by quantity, gross revenue, grouped by (product id, name)."""
    gross = F.col("unit_price") * F.col("quantity")
    sold = _sold_by_product(invoices, lines, tenant_id, line_key, gross, paid_only=True)
    keys = _keys(tenant_id, "product_id", "product_name")
    g = _with_names(sold, products).groupBy(*keys).agg(
        F.sum("_qty").cast(M.QTY_SUM).alias("total_qty"),
        F.sum("_rev").cast(M.REVENUE_SUM).alias("total_revenue"))
    return _top(g, tenant_id, [pg_desc("total_qty"), F.col("product_id")], k)
