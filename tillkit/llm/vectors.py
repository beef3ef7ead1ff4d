"""Vector tables: which rows take part, and blocks of rows and queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a vector of finite numbers, one per id.

    Rows that repeat an id count once, with the least of their vectors. Empty
    vectors take no part.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    return (rows.select(F.col(vec_id).cast("long").alias("id"),
                        F.transform(x, lambda e: e.cast("double")).alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def block_of(column: str, blocks: int) -> Column:
    """Block of a row, by the hash of its id."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(blocks)).cast("int")


def matrix(column, kind=np.float64) -> np.ndarray:
    """Rows of numbers as one matrix; shorter rows end in zeros."""
    rows = [np.asarray(r, dtype=kind) for r in column]
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), dtype=kind)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def dot(a: Column, b: Column, zero: Column) -> Column:
    """Inner product of two arrays, summed from the first component on."""
    parts = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, zero))
    return F.aggregate(parts, zero, lambda s, x: s + x)


def best(scores: np.ndarray, ids: np.ndarray, k: int, none=-np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indexes of each row's k highest scores (``none``: no candidate), ties to smaller ids."""
    k = min(k, scores.shape[1])
    if not k:
        return np.empty(0, int), np.empty(0, int)
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    row, col = np.nonzero((scores >= edge[:, None]) & (scores > none))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]
