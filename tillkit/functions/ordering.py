"""PostgreSQL ordering semantics.

PostgreSQL sorts NULLs last in ASC and first in DESC; Spark does the
opposite. Every unmarked ORDER BY of the reference goes through these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pg_asc(c) -> Column:
    return _c(c).asc_nulls_last()


def pg_desc(c) -> Column:
    return _c(c).desc_nulls_first()


def nulls_first(c) -> Column:
    return _c(c).asc_nulls_first()
