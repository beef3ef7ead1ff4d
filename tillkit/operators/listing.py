"""Listings, look-ups and scoped reads.

A listing is scan -> filter -> sort. ``tenant_id=None`` means "all tenants"
for tenant-owned tables (the tenant becomes the first sort key); for master
tables with template rows, ``None`` means the template scope, as in the
reference. Sorting follows PostgreSQL's NULL placement (N11).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillkit.functions import predicates as P
from tillkit.functions.ordering import nulls_first, pg_asc, pg_desc
from tillkit.functions.text import default_if_blank
from tillkit.sources import seeds


def _owned(df: DataFrame, tenant_id, live: bool) -> DataFrame:
    preds = [P.tenant_is(tenant_id) if tenant_id is not None else None,
             P.is_live() if live else None]
    return df.filter(P.all_of(*preds))


def _lead(tenant_id) -> list:
    return [] if tenant_id is not None else [pg_asc("tenant_id")]


def list_tenants(tenants: DataFrame) -> DataFrame:
    """L1: every tenant by id."""
    return tenants.orderBy(pg_asc("id"))


def list_products(products: DataFrame, tenant_id=None) -> DataFrame:
    """L2: live products of a tenant by id."""
    return _owned(products, tenant_id, True).orderBy(*_lead(tenant_id), pg_asc("id"))


def list_customers(customers: DataFrame, tenant_id=None) -> DataFrame:
    """L3: live customers of a tenant by id."""
    return _owned(customers, tenant_id, True).orderBy(*_lead(tenant_id), pg_asc("id"))


def list_invoices(invoices: DataFrame, tenant_id=None) -> DataFrame:
    """L4: invoices of a tenant, newest first (NULL times first, as PostgreSQL), then by id.

    The all-tenants form is in order by tenant first: Spark range-partitions by
    all three keys, so a large tenant is several tasks and still in one order.
    """
    return _owned(invoices, tenant_id, False).orderBy(*_lead(tenant_id), pg_desc("created_at"), pg_asc("id"))


def get_invoice(invoices: DataFrame, invoice_id, tenant_id) -> DataFrame:
    """one invoice by id within its tenant (empty when not owned)."""
    return invoices.filter((F.col("id") == F.lit(invoice_id)) & P.tenant_is(tenant_id))


def get_invoices(invoices: DataFrame, requests: DataFrame) -> DataFrame:
    """F11 for many (id, tenant_id) requests: the invoices that their tenant owns."""
    return invoices.join(requests.select("id", "tenant_id").distinct(), ["id", "tenant_id"], "left_semi")


def tenant_features(features: DataFrame, tenant_id=None) -> DataFrame:
    """(feature_key, enabled) of a tenant, unordered."""
    return _owned(features, tenant_id, False)


def list_business_types(business_types: DataFrame) -> DataFrame:
    """Live business types by label."""
    return business_types.filter(P.is_live()).orderBy(pg_asc("label"))


def list_uom(uoms: DataFrame, tenant_id=None) -> DataFrame:
    """L7 (strict scope F6): templates when no tenant, else the tenant's own."""
    return uoms.filter(P.is_live() & P.strict_scope(tenant_id)).orderBy(pg_asc("name"))


def list_hsn(hsns: DataFrame, tenant_id=None) -> DataFrame:
    """L9 (strict scope F6) by HSN code."""
    return hsns.filter(P.is_live() & P.strict_scope(tenant_id)).orderBy(pg_asc("hsn_code"))


def list_categories(categories: DataFrame, tenant_id=None, business_type_id=None) -> DataFrame:
    """L8, latest form (strict scope).

    Templates (no tenant): filtered by business type (F7, strict), ordered by
    business type then parent NULLS FIRST, name. A tenant sees only its own
    rows, ordered by parent NULLS FIRST, name.
    """
    if tenant_id is None:
        df = categories.filter(P.is_live() & F.col("tenant_id").isNull()
                               & P.business_type_scope(business_type_id, include_global=False))
        return df.orderBy(nulls_first("business_type_id"), nulls_first("parent_id"),
                          pg_asc("name"))
    df = categories.filter(P.is_live() & P.tenant_is(tenant_id))
    return df.orderBy(nulls_first("parent_id"), pg_asc("name"))


def list_categories_shared(categories: DataFrame, tenant_id=None,
                           business_type_id=None) -> DataFrame:
    """L8, earlier form: global or own rows (F6a), business type or global."""
    df = categories.filter(P.is_live() & P.shared_scope(tenant_id)
                           & P.business_type_scope(business_type_id))
    return df.orderBy(pg_asc("business_type_id"), nulls_first("parent_id"), pg_asc("name"))


def list_tenant_roles(tenant_roles: DataFrame, tenant_id=None) -> DataFrame:
    """Live custom roles of a tenant by name."""
    return _owned(tenant_roles, tenant_id, True).orderBy(*_lead(tenant_id), pg_asc("name"))


def list_tables(tables: DataFrame, tenant_id=None) -> DataFrame:
    """Restaurant tables of a tenant by id."""
    return (_owned(tables, tenant_id, False)
            .select(*(["tenant_id"] if tenant_id is None else []),
                    "id", "table_number", "capacity", "is_occupied")
            .orderBy(*_lead(tenant_id), pg_asc("id")))


def admin_visible_roles(roles: DataFrame) -> DataFrame:
    """The system roles a super admin may assign (tenant_admin only)."""
    return roles.filter(F.col("name") == "tenant_admin").orderBy(pg_asc("id"))


def menu_tree(menus: DataFrame) -> DataFrame:
    """Live menus in tree order: parent NULLS FIRST, sort order, name."""
    return menus.filter(P.is_live()).orderBy(nulls_first("parent_id"), pg_asc("sort_order"),
                                             pg_asc("name"))


def tenant_branding(tenants: DataFrame) -> DataFrame:
    """tenant name and theme colour, with defaults when NULL or empty."""
    return tenants.select(
        F.col("id").alias("tenant_id"),
        default_if_blank(F.col("name"), seeds.DEFAULT_TENANT_NAME).alias("tenant_name"),
        default_if_blank(F.col("theme_color"), seeds.DEFAULT_THEME_COLOR).alias("theme_color"))


def first_row(df: DataFrame, *order) -> DataFrame:
    """The first row by ``order``, or nothing (``LIMIT 1`` made deterministic)."""
    return df.orderBy(*order).limit(1)


def some_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """``LIMIT n``, made deterministic by an order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)
