"""Text formats of the reference (X7-X9, X14-X17), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: formats that must equal the reference's output.
INVOICE_PREFIX = "INV"
INVOICE_SEQ_WIDTH = 4
BARCODE_PREFIX = "8901234"
BARCODE_WIDTH = 6
SKU_PREFIX = "SKU"
SKU_WIDTH = 4


def invoice_number(tenant_id: Column, created_at: Column, seq: Column) -> Column:
    """``'INV-' || tenant || '-' || TO_CHAR(ts,'YYYYMMDD') || '-' || LPAD(seq, 4, '0')``.

    ``concat`` is NULL-propagating like ``||``; ``lpad`` truncates a sequence
    of 10000 to '1000' exactly as PostgreSQL does (N5).
    """
    return F.concat(
        F.lit(INVOICE_PREFIX + "-"), tenant_id.cast("string"), F.lit("-"),
        F.date_format(created_at, "yyyyMMdd"), F.lit("-"),
        F.lpad(seq.cast("string"), INVOICE_SEQ_WIDTH, "0"),
    )


def slug(c: Column) -> Column:
    """Lower case, spaces to underscores."""
    return F.regexp_replace(F.lower(c), " ", "_")


def label(c: Column) -> Column:
    """Underscores to spaces, then title case (``str.title``)."""
    return F.initcap(F.translate(c, "_", " "))


def upper(c: Column) -> Column:
    """X16."""
    return F.upper(c)


def barcode(i: Column) -> Column:
    """``8901234`` followed by the 6-digit zero-filled number."""
    return F.concat(F.lit(BARCODE_PREFIX), F.lpad(i.cast("string"), BARCODE_WIDTH, "0"))


def sku(tenant_id: Column, i: Column) -> Column:
    """``SKU-<tenant>-<4-digit number>``."""
    return F.concat(F.lit(SKU_PREFIX + "-"), tenant_id.cast("string"), F.lit("-"),
                    F.lpad(i.cast("string"), SKU_WIDTH, "0"))


def default_if_blank(c: Column, default: str) -> Column:
    """the value, or ``default`` when NULL or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def permission_summary(view: Column, add: Column, edit: Column, delete: Column) -> Column:
    """J13: 'View, Add, Edit, Delete' for the flags that are TRUE."""
    return F.concat_ws(", ",
                       F.when(view, F.lit("View")), F.when(add, F.lit("Add")),
                       F.when(edit, F.lit("Edit")), F.when(delete, F.lit("Delete")))
