"""Deterministic numbering without one task per group.

``row_number().over(Window.partitionBy(g).orderBy(k))`` sorts each group in a
single task: a tenant-day holding a third of all rows would run in one task.
``sequence_within`` gives the same numbers with bounded tasks:

1. range-partition the rows by (group, order) keys: Spark samples the keys, so
   a hot group is split over several contiguous blocks;
2. sort each block and checkpoint it: a row's position in its block is kept as
   its row id, so numbering needs no second shuffle of the rows;
3. count rows per (group, block) (partial aggregation), and add the running
   total of the earlier blocks of the same group. These offsets are one row per
   group and block; joining them is a broadcast while they are small.

Blocks hold about ``BLOCK_ROWS`` rows, counted from the data, and are never
fewer than the shuffle partitions.

With no group columns it numbers the whole frame (surrogate keys, W2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillkit.sources.tables import materialize

BLOCK_ROWS = 5_000_000


def sequence_within(df: DataFrame, group_cols: list[str], order_cols: list[str | Column],
                    out: str = "seq", num_blocks: int | None = None,
                    skew_safe: bool = True) -> DataFrame:
    """1-based ``row_number`` per group ordered by ``order_cols`` (ascending).

    ``order_cols`` must be a total order within a group (end with a key); a
    Column says itself how it is sorted and where its NULLs go.
    ``skew_safe=False`` uses a plain window (one task per group).
    """
    if not skew_safe:
        w = Window.partitionBy(*group_cols).orderBy(*order_cols)
        return df.withColumn(out, F.row_number().over(w).cast("long"))

    if num_blocks is None:
        num_blocks = max(1, -(-df.count() // BLOCK_ROWS),
                         int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in [*group_cols, *order_cols]]
    # sorted blocks: the low bits of the row id are the position in the block
    blocked = materialize(
        df.repartitionByRange(num_blocks, *keys).sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id()))
    blocked = blocked.withColumn("_blk", F.shiftright("_row", 33))

    counts = blocked.groupBy(*group_cols, "_blk").agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*group_cols).orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_o_{c}") for c in group_cols],
        F.col("_blk").alias("_o_blk"),
        (F.coalesce(F.sum("_cnt").over(before), F.lit(0)) - F.col("_first") + 1).alias("_off"))

    cond = blocked["_blk"] == offsets["_o_blk"]
    for c in group_cols:
        cond = cond & blocked[c].eqNullSafe(offsets[f"_o_{c}"])
    joined = blocked.join(offsets, cond, "inner")
    return (joined.withColumn(out, (F.col("_off") + F.col("_row")).cast("long"))
                  .drop("_blk", "_row", "_off", "_o_blk", *[f"_o_{c}" for c in group_cols]))


def with_position(df: DataFrame, *order: str | Column, within: tuple[str, ...] = (),
                  out: str = "position") -> DataFrame:
    """The 1-based place of each row in the given order (per ``within``).

    What a sorted listing shows only by its sequence becomes a column, without
    sorting everything in one task.
    """
    return sequence_within(df, list(within), list(order), out)


def assign_ids(df: DataFrame, order_cols: list[str], start_after=None,
               out: str = "id", skew_safe: bool = True) -> DataFrame:
    """``SERIAL ... RETURNING id``: ids continue after ``start_after``.

    ``start_after`` is a number or a one-row frame holding the current max id
    (computed with a global aggregate, never collected row by row).
    """
    seq = sequence_within(df, [], order_cols, "_seq", skew_safe=skew_safe)
    if start_after is None:
        return seq.withColumnRenamed("_seq", out)
    if isinstance(start_after, DataFrame):
        # scalar subquery: the current max id, computed by a global aggregate
        base = start_after.select(
            F.coalesce(F.max(start_after.columns[0]), F.lit(0)).cast("long")).scalar()
        return seq.withColumn(out, base + F.col("_seq")).drop("_seq")
    return seq.withColumn(out, F.lit(int(start_after)) + F.col("_seq")).drop("_seq")
