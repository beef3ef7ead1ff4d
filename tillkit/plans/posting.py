"""Invoice posting as a batch job (survey section 3, path 2).

The reference posts one invoice per transaction: price, number, insert, then
one stock UPDATE per line. Here a whole batch of requests is posted at once:

1. keep the requests as files, each row under a number of its own;
2. give ids from a range reserved for the batch (W2, ``sources.ids``) and
   numbers per tenant and day that continue the greatest stored one (B2), on keys
   and times alone; the rows with their items move at most once, to meet their numbers, and
   are priced on the way to the store (B1, nested form);
3. write the batch into its own ``batch_id=<n>`` folder, so re-running a batch
   replaces it (by nothing, if it is empty) instead of adding duplicates; requests that the stored batch already holds keep their ids and
   numbers, and new ones come after everything stored;
4. add what the batch sold to the stock ledger (B3, ``operators.ledger``), which
   reads the batch and the last totals only.

There is no multi-table transaction: invoices are written first, the ledger's
part of the batch is a pure function of them, and a rerun replaces both.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillkit.operators import pricing
from tillkit.operators.ledger import StockLedger
from tillkit.operators.numbering import assign_ids
from tillkit.sources.ids import IdRegister
from tillkit.sources.tables import delete_folder, materialize

#: Columns that posting gives to a request; the number of a kept row, and its bucket key.
_GIVEN, _KEPT, _AT = ("id", "day_seq", "invoice_number"), "_kept", "_at"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored invoices, or None if the path does not exist (any other
    failure to read is an error)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def register_path(invoices_path: str) -> str:
    return f"{invoices_path.rstrip('/')}-ids"


def ledger_path(invoices_path: str) -> str:
    return f"{invoices_path.rstrip('/')}-stock"


def _with_ids(spark: SparkSession, fresh: DataFrame, invoices_path: str, batch_id: int) -> DataFrame:
    """Ids of a range that only this set of requests holds, in (time, request) order."""
    found = fresh.agg(F.count(F.lit(1)).alias("n"), F.min("request_id").alias("a"), F.max("request_id").alias("b"),
                      F.bit_xor(F.xxhash64("request_id")).alias("x")).first()
    if not found.n:
        return fresh.withColumn("id", F.lit(None).cast("long"))
    owner = f"batch-{batch_id}-{found.n}-{found.a}-{found.b}-{found.x}"
    first = IdRegister(spark, register_path(invoices_path)).reserve(owner, found.n)
    return assign_ids(fresh, ["created_at", "request_id"], start_after=first - 1)


def _numbers(spark: SparkSession, rows: DataFrame, invoices_path: str, batch_id: int) -> DataFrame:
    """``_kept`` with its ``id``, ``day_seq`` and ``invoice_number`` beside ``request_id``: those that the
    stored batch gave to the same request, else new ones."""
    def fresh(new: DataFrame, existing: DataFrame | None) -> DataFrame:
        with_ids = _with_ids(spark, new, invoices_path, batch_id)
        return pricing.number_invoices(with_ids, existing=existing, seq="day_seq").select(_KEPT, "request_id", *_GIVEN)

    stored = _stored(spark, invoices_path)
    if stored is None:
        return fresh(rows, None)
    own = stored.filter(F.col("batch_id") == batch_id).select(F.col("request_id").alias("_req"), *_GIVEN)
    if own.isEmpty():
        return fresh(rows, stored)
    known = materialize(rows.join(own, rows["request_id"] == own["_req"], "left"))
    again = known.filter(F.col("_req").isNotNull()).select(_KEPT, "request_id", *_GIVEN)
    new = known.filter(F.col("_req").isNull()).select(*rows.columns)
    # read back before the batch's own partition is replaced
    return materialize(again.unionByName(fresh(new, stored)))


def _at() -> Column:
    """The bucket key of a request: its id; those without one lie apart."""
    return F.coalesce("request_id", -1 - F.col(_KEPT))


def _table(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")


def keep_requests(requests: DataFrame, path: str, *folders: str, buckets: int | None = None) -> DataFrame:
    """Requests written to ``path``, each row under a number of its own, and read back.

    What ``post_invoices`` is given in this form it reads where it lies, so requests
    that are kept once, a folder per value of ``folders``, can be posted part by part.
    With ``buckets`` they are a table bucketed by request id, whose rows need not move
    to meet their numbers; requests that come by id anyway, in as many shuffle
    partitions, are written as a file per bucket. ``drop_requests`` removes both.
    """
    if "created_at" not in requests.columns:
        requests = requests.withColumn("created_at", F.localtimestamp())
    rows = requests.withColumn(_KEPT, F.monotonically_increasing_id())
    rows = rows.withColumn(_AT, _at())
    writer = rows.write.partitionBy(*folders)
    if buckets is None:
        writer.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)
    writer.format("parquet").bucketBy(buckets, _AT).option("path", path).saveAsTable(_table(path))
    return rows.sparkSession.table(_table(path))


def drop_requests(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
    delete_folder(spark, path)


def post_invoices(spark: SparkSession, requests: DataFrame, invoices_path: str, batch_id: int,
                  version: str = "v3") -> DataFrame:
    """Price, number and store one batch, and post its sales to the stock ledger.

    Returns the stored rows of the batch; ``day_seq`` is the number within the
    tenant's day, which the printed one cuts to four digits (N5).
    """
    scratch = f"{invoices_path.rstrip('/')}-kept-{uuid.uuid4().hex}"
    try:
        kept = requests if _KEPT in requests.columns else keep_requests(requests, scratch)
        keys = kept.select(_KEPT, "request_id", "tenant_id", "created_at")
        numbers = _numbers(spark, keys, invoices_path, batch_id)
        numbers = numbers.select(F.col(_KEPT).alias("_n_kept"), _at().alias("_n_at"), F.col("id").alias("_id"), *_GIVEN[1:])
        # equal in the bucket key alone, or buckets would not do; requests that share an id are told apart by row
        same = (kept[_AT] == F.col("_n_at")) & kept[_KEPT].between(F.col("_n_kept"), F.col("_n_kept"))
        out = pricing.price_invoices(kept.join(numbers, same), version, keep=("_id", *_GIVEN[1:]))
        out = out.withColumnsRenamed({"id": "request_id"}).withColumnsRenamed({"_id": "id"})
        out.write.mode("overwrite").parquet(f"{invoices_path.rstrip('/')}/batch_id={batch_id}")
    finally:
        delete_folder(spark, scratch)
    posted = spark.read.parquet(invoices_path).filter(F.col("batch_id") == batch_id)
    lines = pricing.explode_items(posted, keep=("id", "tenant_id"))
    StockLedger(spark, ledger_path(invoices_path)).post(batch_id, lines)
    return posted


def stock_snapshot(spark: SparkSession, products: DataFrame, invoices_path: str) -> DataFrame:
    """B3 over every posted batch: the product table after all sales, from the ledger's totals."""
    if _stored(spark, invoices_path) is None:
        return products
    return StockLedger(spark, ledger_path(invoices_path)).stock(products)
