"""Grouped counts of the reference's check and migration scripts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def count_by_label(rows: DataFrame, dim: DataFrame, fk: str, dim_key: str = "id",
                   label_col: str = "label", live_only: bool = True) -> DataFrame:
    """A10: rows per dimension label (inner join, then ``groupBy(label).count()``).

    Rows are pre-counted per foreign key before the join, so the join sees
    one row per key and a hot key cannot skew it.
    """
    r = rows
    if live_only and "is_active" in rows.columns:
        r = rows.filter(F.col("is_active") == True)  # noqa: E712
    per_key = r.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("_n"))
    d = dim.select(F.col(dim_key).alias("_dk"), F.col(label_col).alias("label"))
    j = per_key.join(d, per_key["_fk"] == d["_dk"], "inner")
    return j.groupBy("label").agg(F.sum("_n").alias("row_count"))


def rows_per_tenant(tables: Mapping[str, DataFrame], tenant_col: str = "tenant_id") -> DataFrame:
    """Per tenant, the row count of each table (0 when it has none).

    Each table is counted with a partial aggregate first; the per-table counts
    (one row per tenant) are then joined on the tenant.
    """
    out = None
    for name, df in tables.items():
        c = df.groupBy(F.col(tenant_col).alias("tenant_id")).agg(
            F.count(F.lit(1)).alias(f"{name}_count"))
        out = c if out is None else out.join(c, "tenant_id", "full_outer")
    return out.select("tenant_id", *[F.coalesce(F.col(f"{n}_count"), F.lit(0)).alias(f"{n}_count")
                                     for n in tables])


def duplicates_keep_least(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Per key that occurs more than once, its count and the least id (the
    row to keep); ``min`` and ``count`` are partially aggregated."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("keep_id"))
              .filter(F.col("copies") > 1))


def duplicate_rows_to_drop(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """The rows of duplicated keys other than the least id (to hard-delete)."""
    keep = df.groupBy(F.col(key).alias("_k")).agg(F.min(id_col).alias("_keep"))
    j = df.join(keep, df[key] == keep["_k"], "inner")
    return j.filter(F.col(id_col) != F.col("_keep")).drop("_k", "_keep")
