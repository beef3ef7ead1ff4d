"""Stock as a ledger (B3): what each batch sold, and running totals.

``<path>/sold/batch_id=<n>/`` holds the units that a batch sold, one row per
(tenant, product); ``<path>/totals/through=<n>/`` the sums of all batches up to
and including n. Posting batch n reads its own lines and the last totals before
it, never the stored invoices. A batch that is posted again replaces its part,
and the totals from it on are written again from the parts, so stock after any
rerun is what it would be had the batch been posted that way at first.

A NULL quantity makes the units of its product unknown (N3): such rows carry a
count of them, so that sums of sums keep it.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillkit.functions.money import QTY

_SOLD = "tenant_id int, product_id long, sold decimal(38,3), unknown long"


def _numbers(spark: SparkSession, folder: str, key: str) -> list[int]:
    """The values of a partition column, from the names of the files alone."""
    try:
        files = spark.read.parquet(folder).inputFiles()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted({int(m.group(1)) for f in files if (m := re.search(rf"/{key}=(\d+)/", f))})


def _part(spark: SparkSession, folder: str, key: str, value: int) -> DataFrame:
    return spark.read.schema(_SOLD).parquet(f"{folder}/{key}={value}")


def sold_units(lines: DataFrame) -> DataFrame:
    """(tenant_id, product_id, sold, unknown) of invoice lines that name a tenant and a product."""
    known = lines.where("tenant_id is not null and product_id is not null")
    return known.groupBy("tenant_id", F.col("product_id").cast("long").alias("product_id")).agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("decimal(38,3)").alias("sold"),
        F.count_if(F.col("quantity").isNull()).alias("unknown"))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("tenant_id", "product_id").agg(
        F.sum("sold").cast("decimal(38,3)").alias("sold"), F.sum("unknown").alias("unknown"))


class StockLedger:
    """The ledger under ``path``; batches have numbers from 0 up."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.sold, self.totals = (f"{path.rstrip('/')}/{x}" for x in ("sold", "totals"))

    def next_totals(self, batch_id: int, before: int | None) -> DataFrame:
        """Totals through ``batch_id``: those through ``before`` and the one part."""
        part = _part(self.spark, self.sold, "batch_id", batch_id)
        if before is None:
            return part
        return _summed(_part(self.spark, self.totals, "through", before).unionByName(part))

    def post(self, batch_id: int, lines: DataFrame) -> None:
        """Store what a batch sold, and all totals that it is part of."""
        sold_units(lines).write.mode("overwrite").parquet(f"{self.sold}/batch_id={batch_id}")
        batches = _numbers(self.spark, self.sold, "batch_id")
        before = max((b for b in batches if b < batch_id), default=None)
        for b in [b for b in batches if b >= batch_id]:
            self.next_totals(b, before).write.mode("overwrite").parquet(f"{self.totals}/through={b}")
            before = b

    def stock(self, products: DataFrame) -> DataFrame:
        """The product table after all posted sales (N4: no floor, unknown products ignored)."""
        posted = _numbers(self.spark, self.totals, "through")
        if not posted:
            return products
        sold = _part(self.spark, self.totals, "through", posted[-1]).select(
            F.col("tenant_id").alias("_st"), F.col("product_id").alias("_sp"), "sold", "unknown")
        j = products.join(sold, (products["tenant_id"] == sold["_st"]) & (products["id"] == sold["_sp"]), "left")
        left = F.when(F.col("_sp").isNull(), F.col("stock_qty")).when(
            F.col("unknown") == 0, (F.col("stock_qty") - F.col("sold")).cast(QTY))
        return j.withColumn("stock_qty", left).drop("_st", "_sp", "sold", "unknown")
