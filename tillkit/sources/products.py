"""The product table in full: the base columns and the retail ones that came later.

``full`` gives a table of any subset of the columns all of them, with the
defaults that the later ALTERs gave to existing rows (M15); ``create`` inserts
rows as the latest procedure does (M5): what a row leaves out is NULL there, but
for the two JSON objects, which default to the empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillkit.functions.money import PRICE, QTY
from tillkit.operators import maintenance

#: Unconstrained NUMERIC columns.
NUMERIC = T.DecimalType(20, 6)

#: Column, type, and the default of rows that were there before (None: NULL).
COLUMNS = [
    ("id", T.LongType(), None), ("tenant_id", T.IntegerType(), None), ("name", T.StringType(), None),
    ("category", T.StringType(), None), ("price", PRICE, None), ("stock_qty", QTY, "0"), ("unit", T.StringType(), None),
    ("barcode", T.StringType(), None), ("sku", T.StringType(), None), ("size", T.StringType(), None),
    ("color", T.StringType(), None), ("imei", T.StringType(), None), ("expiry_date", T.DateType(), None),
    ("is_active", T.BooleanType(), True), ("created_at", T.TimestampNTZType(), None),
    ("subcategory", T.StringType(), None), ("brand", T.StringType(), None), ("hsn_code", T.StringType(), None),
    ("purchase_price", NUMERIC, "0"), ("mrp", NUMERIC, "0"), ("discount", NUMERIC, "0"),
    ("discount_type", T.StringType(), "percent"), ("tax_percent", NUMERIC, "0"), ("min_stock", NUMERIC, "0"),
    ("reorder_level", NUMERIC, "0"), ("batch_number", T.StringType(), None), ("mfg_date", T.DateType(), None),
    ("variants", T.StringType(), "{}"), ("additional_attributes", T.StringType(), "{}"),
]
SCHEMA = T.StructType([T.StructField(n, t) for n, t, _ in COLUMNS])


def full(products: DataFrame) -> DataFrame:
    """``products`` with every column, in table order; missing ones at their defaults."""
    out = products
    for name, kind, default in COLUMNS:
        out = maintenance.add_column(out, name, default, kind.simpleString())
    return out.select(*[F.col(n).cast(t).alias(n) for n, t, _ in COLUMNS])


def create(products: DataFrame, rows: DataFrame, order: Sequence[str], now) -> DataFrame:
    """M5: append ``rows`` to a full product table with new ids, live, created at ``now``."""
    given = rows.withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
    return maintenance.insert_with_defaults(
        products, given, {"variants": "{}", "additional_attributes": "{}", "is_active": True}, order)


def patch(products: DataFrame, changes: DataFrame) -> DataFrame:
    """M1 on a full product table: non-NULL fields of the changes, by id and tenant."""
    return maintenance.patch(products, changes, ["id", "tenant_id"])
