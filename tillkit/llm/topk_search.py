"""Exact top-k by inner product, in three phases with one uniform threshold.

A score is a sum over ``LISTS`` slices of the components; each slice is a score
list that knows only its own part of every score.

1. Each list gives its ``k`` highest local scores per query. The total scores
   of what the lists gave are resolved exactly; the k-th of them is a safe
   cutoff: the final k-th score is no lower.
2. The cutoff goes back to the lists with the queries. A vector whose total
   reaches the cutoff has a local score of at least cutoff / ``LISTS`` in some
   list, whatever the signs, so each list sends the entries that reach it.
3. Entries are summed per query and vector. Vectors that even with the
   threshold in every unseen list stay below the k-th total known are
   dropped; the unseen scores of the others are resolved exactly.

Lists are held in blocks of ``ROWS`` vectors and meet blocks of ``QUERIES``
queries, so a task holds one block of each, however many there are.

Vectors that are null, empty or hold null or non-finite components take no
part; rows that repeat an id count once (least vector); missing components of
shorter vectors count as 0. Scores are whole numbers, exact while they fit 64
bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillkit.llm.common import ship, staged
from tillkit.llm.vectors import best, block_of, dot, matrix, usable

LISTS = 2
ROWS = 8192
QUERIES = 2048
SLICE = 256


#: Stands for a pair that is no candidate.
NONE = np.iinfo(np.int64).min


def _local(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of two blocks of whole numbers.

    Sums must fit 64 bits. Below 2**53 doubles are exact and faster.
    """
    width = max(queries.shape[1], rows.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, rows))
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * width
    if most < 2 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _phase(rows: DataFrame, queries: DataFrame, run) -> DataFrame:
    """``run`` over every pair of a query block and a row block of a list."""
    keys = ["list", "qblock", "rblock"]

    def task(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            ids, body = x["id"].to_numpy(), matrix(x["part"], np.int64)
            for lo in range(0, len(q), SLICE):
                some = q.iloc[lo:lo + SLICE]
                scores = _local(matrix(some["part"], np.int64), body)
                scores[some["id"].to_numpy()[:, None] == ids[None, :]] = NONE
                row, col = run(scores, ids, some)
                out.append(pd.DataFrame({
                    "query_id": some["id"].to_numpy()[row], "list": int(q["list"].iloc[0]),
                    "vec_id": ids[col], "local": scores[row, col]}))
        return pd.concat(out) if out else pd.DataFrame(
            {"query_id": [], "list": [], "vec_id": [], "local": []}).astype("int64")

    return (queries.groupBy(*keys).cogroup(rows.groupBy(*keys))
            .applyInPandas(task, "query_id long, list int, vec_id long, local long"))


def _totals(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (query_id, vec_id) with their exact score."""
    zero = F.lit(0).cast("long")
    q = rows.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    x = rows.select(F.col("id").alias("vec_id"), F.col("v").alias("xv"))
    return pairs.join(x, "vec_id").join(q, "query_id").select(
        "query_id", "vec_id", dot(F.col("qv"), F.col("xv"), zero).alias("score"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id",
          vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products.

    Components become floor(scale * component). ``is_query`` is a condition on
    the column ``id``; a query's candidates are all other rows, ties go to the
    smaller id.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = staged(usable(vectors, vec_id, vector).select(
        "id", F.transform("v", lambda e: F.floor(e * scale).cast("long")).alias("v")), "vectors")
    queries = rows.where(is_query)
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_queries = queries.count()
    rblocks, qblocks = max(1, -(-n // ROWS)), max(1, -(-n_queries // QUERIES))
    width = max(1, -(-dims // LISTS))

    def lists(df: DataFrame, *more: str) -> DataFrame:
        return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(LISTS - 1))).alias("list")).select(
            "id", *more, "list", F.slice("v", F.col("list") * width + 1, F.lit(width)).alias("part"))

    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    listed = (lists(rows).withColumn("rblock", block_of("id", rblocks)).withColumn("qblock", every(qblocks)))
    asked = lambda df, *more: (lists(df, *more).withColumn("qblock", block_of("id", qblocks))
                               .withColumn("rblock", every(rblocks)))

    # 1: local score lists, and the cutoff that they prove
    given = _phase(listed, asked(queries), lambda scores, ids, _: best(scores, ids, k, NONE))
    in_list = Window.partitionBy("query_id", "list").orderBy(F.desc("local"), "vec_id")
    seen = (given.withColumn("r", F.row_number().over(in_list)).where(F.col("r") <= k)
            .select("query_id", "vec_id").distinct())
    cutoffs = _totals(seen, rows).groupBy("query_id").agg(
        F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("cutoff"))
    # a candidate that reaches the cutoff has this much in one list at least (the quotient, rounded up)
    need = F.expr(f"cutoff div {LISTS} + if(cutoff % {LISTS} > 0, 1, 0)")
    asking = staged(queries.join(cutoffs.withColumnRenamed("query_id", "id"), "id", "left")
                    .withColumn("need", F.coalesce(need, F.lit(int(NONE) + 1))), "cutoffs")

    # 2: entries that reach the uniform threshold
    def reach(scores: np.ndarray, ids: np.ndarray, some: pd.DataFrame):
        return np.nonzero(scores >= some["need"].to_numpy()[:, None])

    entries = _phase(listed, asked(asking, "need"), reach)
    summed = entries.groupBy("query_id", "vec_id").agg(
        F.sum("local").alias("part"), F.count(F.lit(1)).alias("lists"))
    bounded = staged(summed.join(asking.select(F.col("id").alias("query_id"), "cutoff", "need"), "query_id"), "entries")

    # 3: drop what cannot reach the k-th known total, resolve the rest
    whole = Window.partitionBy("query_id").orderBy(F.desc("part"), "vec_id")
    known = (bounded.where(F.col("lists") == LISTS).withColumn("r", F.row_number().over(whole))
             .where(F.col("r") == k).select("query_id", F.col("part").alias("floor")))
    most = F.col("part") + (LISTS - F.col("lists")) * F.col("need")
    left = (bounded.join(known, "query_id", "left")
            .where(F.col("floor").isNull() | F.col("cutoff").isNull() | (most >= F.col("floor"))))
    done = left.where(F.col("lists") == LISTS).select("query_id", "vec_id", F.col("part").alias("score"))
    rest = _totals(left.where(F.col("lists") < LISTS).select("query_id", "vec_id"), rows)
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (done.unionByName(rest).withColumn("rank", F.row_number().over(final))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
