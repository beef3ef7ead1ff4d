"""Tables stored by key bucket, of which a change rewrites a part.

Rows lie in folders ``bucket=<b>``, b from the hash of the key columns. A table
of changes touches the buckets of its keys: only those are read, changed by one
of the transforms of ``operators.maintenance``, and written again with dynamic
partition overwrite; all other files stay as they are. The changed buckets are
written to a folder of their own first, so a job that fails has replaced
nothing, and one that is run again reads what was there.

``buckets`` is fixed when the table is written. Give it so that a bucket is
about a file (some 100 to 500 MB): a change of few keys then costs few files,
whatever the size of the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: More buckets than this would make folder listings the cost of a change.
MOST_BUCKETS = 100_000


class BucketTable:
    """A table under ``path``, bucketed by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int) -> None:
        if not 0 < buckets <= MOST_BUCKETS:
            raise ValueError(f"1 to {MOST_BUCKETS} buckets")
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        # one task per bucket, so a bucket is one file
        (rows.withColumn("bucket", self._bucket()).repartition(F.col("bucket"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))

    def create(self, rows: DataFrame) -> None:
        self._write(rows, f"{self.path}/table")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/table")

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets of the changed keys: at most ``buckets`` numbers."""
        return sorted(r.b for r in changes.select(self._bucket().alias("b")).distinct().collect())

    def part(self, touched: list[int]) -> DataFrame:
        """The rows of some buckets; other folders are not read."""
        return self._stored().filter(F.col("bucket").isin(touched)).drop("bucket")

    def change(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Apply ``how(rows, changes)`` to the buckets that ``changes`` touch; returns them.

        ``how`` must keep the columns and leave rows of other keys alone, and
        must not empty a bucket (an overwrite by nothing replaces nothing).
        """
        touched = self.touched(changes)
        if touched:
            staged = f"{self.path}/staged-{uuid.uuid4().hex}"
            how(self.part(touched), changes).write.parquet(staged)
            self._write(self.spark.read.parquet(staged), f"{self.path}/table")
        return touched
