"""Row predicates of the reference's WHERE clauses.

Each builder returns a Column (or ``None`` when the optional argument is
absent), so callers can ``filter`` with it and Catalyst pushes it into the
parquet scan. Optional arguments are dropped in Python (F3) rather than
encoded as ``p IS NULL OR ...``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(*preds: Column) -> Column:
    """OR of the given predicates; FALSE when there is none."""
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def all_of(*preds: Column | None) -> Column:
    """AND of the given predicates, skipping ``None``; TRUE when none is left."""
    kept = [p for p in preds if p is not None]
    if not kept:
        return F.lit(True)
    return reduce(lambda a, b: a & b, kept)


def tenant_is(tenant_id, col: str = "tenant_id") -> Column:
    """``tenant_id = p``. A NULL argument matches nothing, as in SQL."""
    if tenant_id is None:
        return F.lit(False)
    return F.col(col) == F.lit(tenant_id)


def is_live(col: str = "is_active") -> Column:
    """``is_active = TRUE``; NULL is dropped."""
    return F.col(col) == F.lit(True)


def optional_eq(col: str, value) -> Column | None:
    """``(p IS NULL OR col = p)``, as no predicate when ``value`` is None."""
    if value is None:
        return None
    return F.col(col) == F.lit(value)


def _as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


def created_between(start=None, end=None, col: str = "created_at") -> Column | None:
    """F4 with N8: ``created_at >= start AND created_at <= end + 1 day``.

    The upper bound is inclusive of midnight of the next day, as in the
    reference. Bounds are literals, so the comparison reaches the scan.
    """
    preds = []
    if start is not None:
        s = dt.datetime.combine(_as_date(start), dt.time())
        preds.append(F.col(col) >= F.lit(s).cast("timestamp_ntz"))
    if end is not None:
        e = dt.datetime.combine(_as_date(end) + dt.timedelta(days=1), dt.time())
        preds.append(F.col(col) <= F.lit(e).cast("timestamp_ntz"))
    return all_of(*preds) if preds else None


def status_is(status: str, col: str = "payment_status") -> Column:
    """a fixed status value."""
    return F.col(col) == F.lit(status)


def strict_scope(tenant_id, col: str = "tenant_id") -> Column:
    """template rows (tenant NULL) when no tenant is given, else own rows."""
    if tenant_id is None:
        return F.col(col).isNull()
    return F.col(col) == F.lit(tenant_id)


def shared_scope(tenant_id, col: str = "tenant_id") -> Column:
    """Global rows or own rows: ``tenant_id IS NULL OR tenant_id = p``."""
    if tenant_id is None:
        return F.col(col).isNull()
    return F.col(col).isNull() | (F.col(col) == F.lit(tenant_id))


def business_type_scope(business_type_id, col: str = "business_type_id",
                        include_global: bool = True) -> Column:
    """``bt IS NULL OR bt = p OR p IS NULL`` (strict form without ``bt IS NULL``)."""
    if business_type_id is None:
        return F.lit(True)
    match = F.col(col) == F.lit(business_type_id)
    return (F.col(col).isNull() | match) if include_global else match


def route_in(routes: Iterable[str], col: str = "route", negate: bool = False) -> Column:
    """F8: inclusion / exclusion list."""
    p = F.col(col).isin(list(routes))
    return ~p if negate else p


def admin_override(key_col: str, key, tenant_id, tenant_col: str = "tenant_id") -> Column:
    """``id = p AND (tenant_id = t OR t IS NULL)``."""
    p = F.col(key_col) == F.lit(key)
    if tenant_id is None:
        return p
    return p & (F.col(tenant_col) == F.lit(tenant_id))
