"""Schemas of the billing tables and of an invoice request.

Keys are ``LongType``: a SERIAL ``INT`` would overflow at the target scale.
Tenant ids stay ``IntegerType`` (one row per business).
"""

from __future__ import annotations

from pyspark.sql import types as T

from tillkit.functions.money import ITEM_PRICE, ITEM_QTY, MONEY, PRICE, QTY, RATE, exact

ITEM = T.StructType([
    T.StructField("product_id", T.LongType(), True),
    T.StructField("quantity", ITEM_QTY, True),
    T.StructField("unit_price", ITEM_PRICE, True),
    T.StructField("discount", ITEM_PRICE, True),
    T.StructField("discount_type", T.StringType(), True),
    T.StructField("tax_percent", RATE, True),
])

ITEMS = T.ArrayType(ITEM, True)
#: Items as JSON has them: numbers of up to 20 digits before the point and 18 after it.
WIDE_ITEM = T.StructType([T.StructField(f.name, T.DecimalType(38, 18) if isinstance(f.dataType, T.DecimalType) else f.dataType)
                          for f in ITEM.fields])

# One row per invoice to post (the 11 arguments of sp_create_invoice, plus the
# request id and time that NOW() / SERIAL supply in the reference).
INVOICE_REQUEST = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("tenant_id", T.IntegerType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("items", ITEMS, True),
    T.StructField("payment_method", T.StringType(), True),
    T.StructField("paid_amount", MONEY, True),
    T.StructField("invoice_status", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("table_id", T.LongType(), True),
    T.StructField("kot_id", T.LongType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

# Flat invoice lines (the normalised form of ``items``).
INVOICE_LINE = T.StructType([
    T.StructField("invoice_id", T.LongType(), False),
    T.StructField("line_no", T.IntegerType(), True),
] + list(ITEM.fields))

PRODUCT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("tenant_id", T.IntegerType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("price", PRICE, True),
    T.StructField("stock_qty", QTY, True),
    T.StructField("is_active", T.BooleanType(), True),
])

USER = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("username", T.StringType(), True),
    T.StructField("full_name", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
    T.StructField("role_id", T.IntegerType(), True),
    T.StructField("tenant_id", T.IntegerType(), True),
    T.StructField("tenant_role_id", T.LongType(), True),
    T.StructField("is_active", T.BooleanType(), True),
    T.StructField("created_at", T.DateType(), True),
])


def parse_items(json_text):
    """Decode a JSON array of invoice lines (the JSONB ``items`` text) into
    ``array<struct>``.

    Numbers are read with 18 places and must fit the item's types as they are: a
    number of more places than those hold fails the query (``money.exact``), it
    is not rounded. Text that is no JSON, or a number that is none, fails it
    too, as a cast to JSONB or NUMERIC does; it never becomes an invoice of 0."""
    from pyspark.sql import functions as F

    return exact_items(F.from_json(json_text, T.ArrayType(WIDE_ITEM), {"mode": "FAILFAST"}))


def exact_items(items):
    """An array of items of any decimal types, in the item's own; nothing is rounded."""
    from pyspark.sql import functions as F

    return F.transform(items, lambda x: F.when(x.isNotNull(), F.struct(*[
        (exact(x[f.name], f.dataType) if isinstance(f.dataType, T.DecimalType) else x[f.name]).alias(f.name)
        for f in ITEM.fields])))


def items_json(items):
    """S3: encode an ``items`` array back to JSON text."""
    from pyspark.sql import functions as F

    return F.to_json(items)
