"""Exact decimal expressions for invoice pricing.

All money math is decimal, never double. Spark widens decimal precision on
``*`` and ``+``; past 38 digits it silently drops *scale*. Every step below
is therefore cast to a type whose precision leaves room for the next step, so
no digit is lost:

==============  =================  ==========================================
value           type               why
==============  =================  ==========================================
item price      decimal(14,4)      JSON numbers keep 4 places (NUMERIC there)
item discount   decimal(14,4)      amount or percent, 4 places
item quantity   decimal(13,4)      4 places
tax_percent     decimal(7,4)       4 places
line_total      decimal(24,8)      price * quantity, exact
percent / 100   decimal(13,6)      discount * 0.01, exact
discount        decimal(38,14)     line_total * (discount / 100), exact
tax rate        decimal(7,6)       tax_percent * 0.01, exact
tax             decimal(38,20)     (line_total - discount) * rate, exact
invoice sums    decimal(38,20)     working type of the invoice-level fold
stored price    decimal(12,2)      NUMERIC(12,2) column of products
stored quantity decimal(12,3)      NUMERIC(12,3) column of products
stored totals   decimal(12,2)      rounded HALF_UP on store (N1)
==============  =================  ==========================================

Inputs are rounded by no step before the store. A line total has room for 16
digits before the point, an invoice for 18. An item whose numbers have more places
fails the query (``exact``); ``quality.item_scale_violations`` reports those of
JSON items beforehand.

The three versions of the pricing procedure are selected by ``PricingVersion``.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE = T.DecimalType(12, 2)
QTY = T.DecimalType(12, 3)
ITEM_PRICE = T.DecimalType(14, 4)
ITEM_QTY = T.DecimalType(13, 4)
RATE = T.DecimalType(7, 4)
LINE = T.DecimalType(24, 8)
PCT = T.DecimalType(13, 6)
DISC = T.DecimalType(38, 14)
TAX_RATE = T.DecimalType(7, 6)
NET = T.DecimalType(30, 14)
TAX = T.DecimalType(38, 20)
WORK = T.DecimalType(38, 20)
MONEY = T.DecimalType(12, 2)
# Report sums keep scale 2 and the widest precision.
MONEY_SUM = T.DecimalType(38, 2)
QTY_SUM = T.DecimalType(38, 3)
REVENUE_SUM = T.DecimalType(38, 8)


def _hundredth() -> Column:
    return F.lit(Decimal("0.01"))


@dataclass(frozen=True)
class PricingVersion:
    """Options that distinguish the three generations of invoice pricing.

    * ``honour_discount_type``: v1 always treats ``discount`` as an amount.
    * ``default_discount_type``: type used when a line has none
      ('fixed' in v3, 'percent' in v2).
    * ``bill_discount``: v3 reads ``metadata.bill_discount``.
    * ``floor_at_zero``: v3 clamps the grand total at 0.
    * ``has_balance``: v2/v3 store paid_amount and balance.
    """

    name: str
    honour_discount_type: bool
    default_discount_type: str
    bill_discount: bool
    floor_at_zero: bool
    has_balance: bool


V1 = PricingVersion("v1", False, "fixed", False, False, False)
V2 = PricingVersion("v2", True, "percent", False, False, True)
V3 = PricingVersion("v3", True, "fixed", True, True, True)
VERSIONS = {"v1": V1, "v2": V2, "v3": V3}


def exact(c: Column, kind: T.DecimalType) -> Column:
    """``c`` as ``kind``, failing the query if that would change the value."""
    as_kind = c.try_cast(kind)
    wrong = F.raise_error(F.concat(F.lit("a number does not fit " + kind.simpleString() + ": "), c.cast("string")))
    return F.when(c.isNull() | (as_kind == c), as_kind).otherwise(wrong.cast(kind))


def line_total(unit_price: Column, quantity: Column) -> Column:
    """unit_price * quantity, exact (NULL when either is NULL, N3)."""
    return (unit_price.cast(ITEM_PRICE) * quantity.cast(ITEM_QTY)).cast(LINE)


def line_discount(lt: Column, discount: Column, discount_type: Column,
                  version: PricingVersion = V3) -> Column:
    """Discount amount of one line: an amount, or a percentage of the line total."""
    d = F.coalesce(discount.cast(ITEM_PRICE), F.lit(0).cast(ITEM_PRICE))
    amount = d.cast(DISC)
    if not version.honour_discount_type:
        return amount
    kind = F.coalesce(discount_type, F.lit(version.default_discount_type))
    percent = (lt * (d * _hundredth()).cast(PCT)).cast(DISC)
    return F.when(kind == F.lit("percent"), percent).otherwise(amount)


def line_tax(lt: Column, disc: Column, tax_percent: Column) -> Column:
    """(line_total - discount) * tax_percent / 100, exact."""
    rate = (F.coalesce(tax_percent.cast(RATE), F.lit(0).cast(RATE)) * _hundredth()).cast(TAX_RATE)
    return ((lt.cast(NET) - disc.cast(NET)).cast(NET) * rate).cast(TAX)


def line_amounts(unit_price: Column, quantity: Column, discount: Column,
                 discount_type: Column, tax_percent: Column,
                 version: PricingVersion = V3) -> tuple[Column, Column, Column]:
    """(line_total, discount, tax) of one line."""
    lt = line_total(unit_price, quantity)
    disc = line_discount(lt, discount, discount_type, version)
    return lt, disc, line_tax(lt, disc, tax_percent)


def strict_sum(c: Column) -> Column:
    """SUM that is NULL as soon as one term is NULL (a procedural ``v := v + x``).

    Spark's ``sum`` skips NULLs; the reference's running total does not (N3).
    Both parts are algebraic aggregates, so partial aggregation still applies.
    """
    return F.when(F.count_if(c.isNull()) > 0, F.lit(None)).otherwise(F.sum(c))


def bill_discount_from_metadata(metadata: Column) -> Column:
    """COALESCE(metadata->>'bill_discount', 0) as the working decimal type."""
    raw = F.get_json_object(metadata, "$.bill_discount")
    return F.coalesce(raw.cast(WORK), F.lit(0).cast(WORK))


def to_money(c: Column) -> Column:
    """Round HALF_UP to NUMERIC(12,2), as an insert into a money column does."""
    return c.cast(MONEY)
