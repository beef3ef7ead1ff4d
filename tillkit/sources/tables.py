"""Table scans and sinks.

Reads are lazy: selecting columns and filtering after ``read_table`` lets
Catalyst prune the parquet ``ReadSchema`` and push filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """One parquet table under ``base_dir``."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def append_partitioned(df: DataFrame, path: str, partition_col: str = "tenant_id") -> None:
    """Append rows, one folder per tenant (partition pruning on read).

    Rows are rebalanced by the partition column first, so that each task writes
    few files per tenant instead of one file per (task, tenant) pair; adaptive
    execution splits a large tenant over several tasks.
    """
    (df.hint("rebalance", partition_col)
       .write.mode("append")
       .partitionBy(partition_col)
       .parquet(path))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str,
                   mode: str = "overwrite") -> None:
    """Store a table bucketed and sorted by ``key`` (co-located joins).

    Invoice headers and lines written with the same key and bucket count join
    and aggregate on the invoice id without any shuffle: each task reads the
    matching bucket files of both tables. ``path`` names the table location
    (shared storage on a cluster); the table is registered in the session
    catalog as ``table``.
    """
    (df.write.mode(mode).format("parquet")
       .bucketBy(buckets, key).sortBy(key)
       .option("path", path)
       .saveAsTable(table))


def as_json_rows(df: DataFrame, col: str = "json") -> DataFrame:
    """Each row as one JSON object (the HTTP layer's ``mappings()``)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(col))


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    Used where a frame is read twice and must give the same rows both times
    (numbering by physical range), and to keep retried stages from recomputing
    a long lineage after an executor is lost.
    """
    from tillkit.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder and all in it, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
