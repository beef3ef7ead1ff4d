"""Seed generators (S7-S9), per tenant and without driver loops.

Each generator expands a tenant frame with a bounded, fixed fan-out
(``explode`` of a literal array or of ``sequence(1, n)``), then inserts only
what is missing (J10), so a rerun adds nothing.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillkit.functions.money import PRICE, QTY
from tillkit.functions.text import barcode, sku
from tillkit.operators.maintenance import _append_with_ids, missing_only
from tillkit.sources import seeds

# FIXED VALUES of the synthetic product generator.
PRODUCTS_PER_TENANT = 100
PRICE_MIN, PRICE_MAX = 10.0, 2000.0
STOCK_MIN, STOCK_MAX = 10, 500
PURCHASE_FACTOR, MRP_FACTOR = Decimal("0.8"), Decimal("1.2")
DEFAULT_TAX_PERCENT, DEFAULT_MIN_STOCK, DEFAULT_REORDER = 18.0, 5.0, 10.0


def seed_category_templates(categories: DataFrame, business_types: DataFrame,
                            templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Add the per-business-type category templates whose (name, type) is new.

    Business types named in ``templates`` but absent from ``business_types``
    are skipped (inner join).
    """
    spark = categories.sparkSession
    templates = templates or seeds.CATEGORY_TEMPLATES
    rows = [(bt, name, i) for bt, names in templates.items() for i, name in enumerate(names)]
    lit = spark.createDataFrame(rows, "bt_name string, name string, pos int")
    bt = business_types.select(F.col("id").alias("business_type_id"), F.col("name").alias("_bt"))
    new = (lit.join(bt, lit["bt_name"] == bt["_bt"], "inner")
           .select("name", F.lit(None).cast("int").alias("parent_id"),
                   F.lit(None).cast("int").alias("tenant_id"), "business_type_id",
                   F.lit(True).alias("is_active"), "pos"))
    new = missing_only(new, categories, ["name", "business_type_id"])
    return _append_with_ids(categories, new, ["business_type_id", "pos"])


def synthetic_products(tenants: DataFrame, seed: int = 42,
                       n: int = PRODUCTS_PER_TENANT) -> DataFrame:
    """``n`` synthetic products per tenant (name, category, price, stock,
    unit, barcode, SKU, HSN), from seeded ``rand`` -- one row per (tenant, i).

    Values are deterministic for a given seed and input partitioning; the
    reference's generator is random too, so only the shape and ranges match.
    """
    def pick(words, salt):
        arr = F.array(*[F.lit(w) for w in words])
        idx = (F.floor(F.rand(seed + salt) * len(words)) + 1).cast("int")
        return F.element_at(arr, idx)

    base = tenants.select(F.col("id").cast("int").alias("tenant_id"),
                          F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    # whole cents, then decimal arithmetic: prices are never double
    cents = F.floor(F.rand(seed + 3) * int((PRICE_MAX - PRICE_MIN) * 100 + 1)) + int(PRICE_MIN * 100)
    price = (cents.cast("decimal(12,0)") * F.lit(Decimal("0.01"))).cast(PRICE)
    stock = F.floor(F.lit(STOCK_MIN) + F.rand(seed + 4) * (STOCK_MAX - STOCK_MIN + 1))
    return base.select(
        "tenant_id",
        F.concat_ws(" ", pick(seeds.PRODUCT_PREFIXES, 1), pick(seeds.PRODUCT_BASES, 2),
                    F.col("i").cast("string")).alias("name"),
        pick(seeds.PRODUCT_CATEGORIES, 5).alias("category"),
        price.cast(PRICE).alias("price"),
        (price * F.lit(PURCHASE_FACTOR)).cast(PRICE).alias("purchase_price"),
        (price * F.lit(MRP_FACTOR)).cast(PRICE).alias("mrp"),
        F.lit(DEFAULT_TAX_PERCENT).alias("tax_percent"),
        stock.cast(QTY).alias("stock_qty"),
        F.lit(DEFAULT_MIN_STOCK).alias("min_stock"),
        F.lit(DEFAULT_REORDER).alias("reorder_level"),
        pick(seeds.PRODUCT_UNITS, 6).alias("unit"),
        barcode(F.col("i")).alias("barcode"),
        sku(F.col("tenant_id"), F.col("i")).alias("sku"),
        pick(seeds.PRODUCT_HSNS, 7).alias("hsn_code"),
    )


def seed_products(products: DataFrame, tenants: DataFrame, seed: int = 42) -> DataFrame:
    """S8 + M3: append synthetic products whose (tenant, SKU) is new."""
    gen = synthetic_products(tenants, seed)
    new = missing_only(gen, products, ["tenant_id", "sku"])
    return new


def seed_tables(tables: DataFrame, tenant_features: DataFrame,
                n: int = seeds.SEEDED_TABLES_PER_TENANT) -> DataFrame:
    """20 tables (capacity 4, free) for every tenant with table management
    enabled and no tables yet."""
    want = tenant_features.filter((F.col("feature_key") == "table_mgmt")
                                  & (F.col("enabled") == True)).select("tenant_id")  # noqa: E712
    todo = missing_only(want.dropDuplicates(), tables, ["tenant_id"])
    rows = todo.select("tenant_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_i")).select(
        "tenant_id", F.col("_i").cast("string").alias("table_number"),
        F.lit(seeds.SEEDED_TABLE_CAPACITY).alias("capacity"), F.lit(False).alias("is_occupied"),
        "_i")
    return _append_with_ids(tables, rows, ["tenant_id", "_i"])
