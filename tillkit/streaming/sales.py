"""Structured Streaming forms of daily sales (T1), invoice posting (T2) and numbering (B2).

* ``append_daily_sales`` emits a (tenant, day) once, when the watermark has
  passed it, and its state leaves; later invoices of that day are dropped.
* ``number_stream`` keeps the last number of each tenant's days in the state
  store, so numbers go on over micro-batches; the state of a month leaves when
  the watermark has passed it.
* ``arrive`` replays a finished table as it would have come in: a slice is
  added to the file source, the stream takes what is there, and so on.

The other two write with ``foreachBatch`` into a folder of per-batch parts:
``<sink>/batch_id=<n>/``. Each micro-batch overwrites only its own part, so
a batch retried after a failure (or an executor loss) replaces its earlier
attempt instead of adding duplicates: the sink is exactly-once on top of the
checkpointed source offsets. Checkpoint and sink locations are arguments; on
a cluster they must name shared storage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tillkit.functions.money import MONEY_SUM
from tillkit.functions.text import invoice_number
from tillkit.operators import pricing

DAY = "1 day"


def daily_sales_updates(invoices: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Running revenue and count per (tenant, day) of a stream of invoices.

    Late invoices are accepted until the watermark passes their day; after
    that the (tenant, day) state is dropped, so state stays bounded.
    """
    # Watermarks need TIMESTAMP; invoice times are TIMESTAMP_NTZ (wall clock).
    # The event time is the instant whose UTC wall clock is the invoice's, so
    # the UTC-aligned day windows are the invoice's calendar days in any
    # session time zone; the window start is mapped back the same way.
    tz = invoices.sparkSession.conf.get("spark.sql.session.timeZone")
    ev = invoices.withColumn(
        "_event_time", F.from_utc_timestamp(F.col("created_at").cast("timestamp"), tz))
    w = (ev.withWatermark("_event_time", watermark)
         .groupBy("tenant_id", F.window("_event_time", DAY).alias("w"))
         .agg(F.sum("grand_total").cast(MONEY_SUM).alias("total_revenue"),
              F.count("id").alias("total_invoices")))
    day = F.to_date(F.to_utc_timestamp(F.col("w.start"), tz))
    return w.select("tenant_id", day.alias("sale_date"), "total_revenue", "total_invoices")


def _write_part(df: DataFrame, sink: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")


def start_daily_sales(invoices: DataFrame, sink: str, checkpoint: str,
                      watermark: str = "2 days", available_now: bool = True) -> StreamingQuery:
    """Run T1 in update mode; every batch writes the (tenant, day) rows it changed."""
    updates = daily_sales_updates(invoices, watermark)
    writer = (updates.writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, bid: _write_part(df, sink, bid)))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_daily_sales(spark: SparkSession, sink: str) -> DataFrame:
    """Current daily sales: for each (tenant, day) the row of the latest batch.

    ``max_by`` is an aggregate with partial aggregation, so a (tenant, day)
    updated in many batches is reduced on the map side.
    """
    parts = spark.read.parquet(sink)
    latest = parts.groupBy("tenant_id", "sale_date").agg(
        F.max_by(F.struct("total_revenue", "total_invoices"), F.col("batch_id")).alias("_v"))
    return latest.select("tenant_id", "sale_date", "_v.total_revenue", "_v.total_invoices")


def start_invoice_posting(requests: DataFrame, sink: str, checkpoint: str, version: str = "v3",
                          available_now: bool = True) -> StreamingQuery:
    """Price each micro-batch of nested invoice requests (B1, no shuffle)
    and append the priced invoices, partitioned by batch then tenant."""
    def post(df: DataFrame, batch_id: int) -> None:
        priced = pricing.price_invoices(df, version).drop("items")
        (priced.write.mode("overwrite").partitionBy("tenant_id")
         .parquet(f"{sink.rstrip('/')}/batch_id={batch_id}"))

    writer = (requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(post))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def replay_daily_sales(invoices: DataFrame, root: str, watermark: str = "36500 days") -> DataFrame:
    """Run T1 over a finished set of invoices: write them as the stream's file
    source under ``root``, process everything available, return the sink.

    The default watermark accepts any lateness, so a historical replay whose
    files arrive in arbitrary time order drops nothing.
    """
    spark = invoices.sparkSession
    src = f"{root.rstrip('/')}/source"
    invoices.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = start_daily_sales(stream, f"{root.rstrip('/')}/sink", f"{root.rstrip('/')}/checkpoint",
                          watermark=watermark)
    q.awaitTermination()
    return read_daily_sales(spark, f"{root.rstrip('/')}/sink")


def start_line_posting(headers: DataFrame, lines: DataFrame, sink: str, checkpoint: str,
                       version: str = "v3", available_now: bool = True) -> StreamingQuery:
    """T2 over normalised data: each micro-batch of invoice headers is priced
    against the line table, restricted to that batch's invoice keys (a semi
    join, so only the batch's lines are read past the scan filter)."""
    def post(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            keys = batch.select("request_id")
            priced = pricing.price_invoice_lines(batch, lines, version, restrict_to=keys)
            _write_part(priced, sink, batch_id)
        finally:
            batch.unpersist()

    writer = headers.writeStream.option("checkpointLocation", checkpoint).foreachBatch(post)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def replay_line_posting(headers: DataFrame, lines: DataFrame, root: str,
                        version: str = "v3", files_per_batch: int = 2) -> DataFrame:
    """Run T2 over finished headers: write them as a file source under
    ``root`` and post them in micro-batches of ``files_per_batch`` files;
    returns every posted invoice."""
    spark = headers.sparkSession
    src = f"{root.rstrip('/')}/source"
    headers.write.mode("overwrite").parquet(src)
    stream = (spark.readStream.schema(spark.read.parquet(src).schema)
              .option("maxFilesPerTrigger", files_per_batch).parquet(src))
    sink = f"{root.rstrip('/')}/sink"
    q = start_line_posting(stream, lines, sink, f"{root.rstrip('/')}/checkpoint", version)
    q.awaitTermination()
    return spark.read.parquet(sink).drop("batch_id")


def replay_invoice_posting(requests: DataFrame, root: str, version: str = "v3",
                           files_per_batch: int = 2) -> DataFrame:
    """Run T2 over finished nested requests: write them as a file source under
    ``root`` and post them in micro-batches of ``files_per_batch`` files, each
    priced by itself without any join; returns every posted invoice."""
    spark = requests.sparkSession
    base = root.rstrip("/")
    requests.write.mode("overwrite").parquet(f"{base}/source")
    stream = (spark.readStream.schema(spark.read.parquet(f"{base}/source").schema)
              .option("maxFilesPerTrigger", files_per_batch).parquet(f"{base}/source"))
    start_invoice_posting(stream, f"{base}/sink", f"{base}/checkpoint", version).awaitTermination()
    posted = spark.read.parquet(f"{base}/sink").drop("batch_id")
    return posted.withColumn("tenant_id", F.col("tenant_id").cast("int"))


# ------------------------------------------------- finished days, numbers

def append_daily_sales(invoices: DataFrame, sink: str, checkpoint: str,
                       watermark: str = "2 days") -> StreamingQuery:
    """T1 in append mode: each (tenant, day) is written once, when it is over.

    A day is over when the watermark (the latest invoice time of earlier
    micro-batches, less the delay) is past its end. Its state then leaves the
    store; an invoice that comes later still is dropped and counted in the
    progress of the query (``numRowsDroppedByWatermark``). The Parquet sink
    commits a micro-batch once.
    """
    return (daily_sales_updates(invoices, watermark).writeStream.outputMode("append").format("parquet")
            .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _local_event_time(df: DataFrame) -> DataFrame:
    """``_event_time``: the instant whose UTC wall clock is ``created_at``."""
    tz = df.sparkSession.conf.get("spark.sql.session.timeZone")
    return df.withColumn("_event_time", F.from_utc_timestamp(F.col("created_at").cast("timestamp"), tz))


def _numbered(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows of a (tenant, month) in a micro-batch, numbered on by day from the state."""
    if state.hasTimedOut:
        state.remove()
        return
    last = np.array(state.get[0] if state.exists else [0] * 31, dtype=np.int64)
    rows = pd.concat(list(frames)).sort_values(["created_at", "id"])
    day = rows["created_at"].dt.day.fillna(1).astype(np.int64).to_numpy() - 1
    rows["seq"] = last[day] + rows.groupby(day).cumcount().to_numpy() + 1
    state.update(((last + np.bincount(day, minlength=31)).tolist(),))
    if key[1] is not None:
        over = int((pd.Timestamp(f"{key[1]}-01", tz="UTC") + pd.offsets.MonthBegin(1)).timestamp() * 1000)
        if over > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(over)
    yield rows[["id", "tenant_id", "created_at", "seq"]]


def number_stream(invoices: DataFrame, watermark: str = "2 days") -> DataFrame:
    """B2 over a stream: id, tenant_id, created_at, invoice_number.

    The state of a (tenant, month) is the last number of each day; within a
    micro-batch rows are numbered by (created_at, id), after those of earlier
    ones. A task holds one tenant's month of one micro-batch, which the source's
    limits bound. (A key of a month, as a call per key costs more than its rows.)
    State leaves when the watermark is the month's end; an invoice that comes
    later than that starts its day anew, so the delay must cover the lateness.
    """
    rows = _local_event_time(invoices.select("id", "tenant_id", "created_at")).withWatermark("_event_time", watermark)
    keyed = rows.withColumn("month", F.date_format("created_at", "yyyy-MM"))
    seq = keyed.groupBy("tenant_id", "month").applyInPandasWithState(
        _numbered, "id long, tenant_id int, created_at timestamp_ntz, seq long", "last array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout)
    return seq.withColumn("invoice_number", invoice_number(F.col("tenant_id"), F.col("created_at"), F.col("seq"))
                          ).drop("seq")


def start_numbering(invoices: DataFrame, sink: str, checkpoint: str, watermark: str = "2 days") -> StreamingQuery:
    """``number_stream`` into a Parquet sink that commits each micro-batch once."""
    return (number_stream(invoices, watermark).writeStream.outputMode("append").format("parquet")
            .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def arrive(rows: DataFrame, by: str, root: str,
           start: Callable[[DataFrame, str, str], StreamingQuery]) -> list[dict]:
    """Let a finished table come in slice after slice; returns the progress of every micro-batch.

    ``by`` numbers the slices. They are written once, by slice; then each is
    added to the stream's file source and the stream, begun by ``start`` on
    (stream, sink, checkpoint), takes all that is there. So slices arrive in
    order, whatever the number of their files.
    """
    spark, base = rows.sparkSession, root.rstrip("/")
    rows.write.partitionBy(by).parquet(f"{base}/slices")
    stored = spark.read.parquet(f"{base}/slices")
    plain = stored.drop(by)
    progress = []
    for (value,) in sorted(stored.select(by).distinct().collect()):
        stored.filter(F.col(by) == value).drop(by).write.mode("append").parquet(f"{base}/source")
        stream = spark.readStream.schema(plain.schema).parquet(f"{base}/source")
        query = start(stream, f"{base}/sink", f"{base}/checkpoint")
        query.awaitTermination()
        progress += [p for p in query.recentProgress]
    return progress
