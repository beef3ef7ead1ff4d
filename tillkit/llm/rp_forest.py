"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample (``SAMPLE`` rows, least hash of the id):
a node projects on the difference of two random rows and splits at the median.
Every row is then indexed in one leaf of every tree. A query searches all
trees through one priority queue: the node whose splits the query misses by
least (sum of squared margins) is opened next, whichever tree it is in, until
the leaves taken hold ``search`` rows. Leaves meet their queries in tasks, by
branches of about ``BRANCH_ROWS`` rows of a tree, which give the nearest rows
of the leaves by exact cosine; the best of all are scored again on the
original vectors.

``budget`` is what recall 0.9 takes with a margin, at every size, on vectors
without any structure (uniform on a sphere of 64 dimensions); clustered vectors
need far less. It counts a row once for each tree that shows it.

A leaf of more than ``BRANCH_ROWS`` rows (equal vectors) is dealt over several
tasks. Vectors that are null, empty, zero or hold null or non-finite
components take no part; rows that repeat an id count once (least vector).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillkit.llm.common import ship, staged
from tillkit.llm.vectors import dot, matrix, usable

TREES = 12
SAMPLE = 16384
LEAF = 48
BRANCH_ROWS = 16384
#: Rows of a query's leaves as a share of all, and what shallow trees of few rows take more, by the square root.
SEARCH_SHARE, SEARCH_ROOT = 0.8, 25.0
#: Matrix products of equal vectors differ by less; all so near to the k-th score stay until the exact one.
NEAR = 1e-12


def budget(n: int) -> int:
    """Rows that the leaves of a query hold together, in a table of ``n``."""
    return int(np.ceil(SEARCH_SHARE * n + SEARCH_ROOT * np.sqrt(n)))


def least_copies(body: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` least ids of each different row."""
    rows = np.ascontiguousarray(body + 0.0)  # -0.0 is 0.0
    _, kind = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).reshape(-1), return_inverse=True)
    order = np.lexsort((ids, kind))
    nth = np.arange(len(order)) - np.searchsorted(kind[order], kind[order])
    return np.sort(order[nth < most])


class Forest:
    """Normals and thresholds of perfect binary trees, in heap order."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
        self.depth, self.trees, self.dims = depth, trees, sample.shape[1]
        self.normal = np.zeros((trees, (1 << depth) - 1, self.dims))
        self.cut = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            members = {0: np.arange(len(unit))}
            for node in range((1 << depth) - 1):
                own = members.pop(node)
                a, b = rng.choice(own, 2) if len(own) > 1 else rng.choice(len(unit), 2)
                w = unit[a] - unit[b]
                if not w.any():
                    w = rng.normal(size=self.dims)
                w /= np.linalg.norm(w)
                side = unit[own] @ w
                cut = float(np.median(side)) if len(own) else 0.0
                self.normal[t, node], self.cut[t, node] = w, cut
                members[2 * node + 1], members[2 * node + 2] = own[side < cut], own[side >= cut]

    def _unit(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.dims))
        out[:, :min(self.dims, x.shape[1])] = x[:, :self.dims]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        unit, out = self._unit(x), np.zeros((len(x), self.trees), dtype=np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", unit, self.normal[t, node]) >= self.cut[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def probes(self, x: np.ndarray, sizes: np.ndarray, search: int) -> list[list[tuple[int, int]]]:
        """Leaves (tree, leaf) to search for each row, nearest first."""
        unit, inner = self._unit(x), (1 << self.depth) - 1
        margins = np.einsum("tnd,qd->qtn", self.normal, unit) - self.cut[None]
        out = []
        for margin in margins:
            queue = [(0.0, t, 0) for t in range(self.trees)]
            taken, rows = [], 0
            while queue and rows < search:
                far, t, node = heapq.heappop(queue)
                if node >= inner:
                    if sizes[t, node - inner]:
                        taken.append((t, node - inner))
                        rows += int(sizes[t, node - inner])
                    continue
                m = margin[t, node]
                heapq.heappush(queue, (far + min(m, 0.0) ** 2, t, 2 * node + 2))
                heapq.heappush(queue, (far + max(m, 0.0) ** 2, t, 2 * node + 1))
            out.append(taken)
        return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id",
            vector: str = "embedding", search: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by cosine.

    ``is_query`` is a condition on the column ``id``; candidates are all other
    rows, ties go to the smaller id. ``search`` rows are looked at per query
    (default: ``budget``), a row as often as trees show it.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = staged(usable(vectors, vec_id, vector).where(F.exists("v", lambda e: e != 0)), "vectors")
    n = rows.count()
    search = search or budget(n)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    sample = matrix(picked["v"])
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    depth = 0
    while (1 << depth) * LEAF < n and (1 << depth) * 16 < len(sample):
        depth += 1
    forest = spark.sparkContext.broadcast(Forest(sample, depth))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            found = f.leaves(matrix(batch.column(1).to_pylist())) if batch.num_rows else np.zeros((0, f.trees), int)
            at = pa.array(np.repeat(np.arange(batch.num_rows), f.trees))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at),
                 pa.array(np.tile(np.arange(f.trees), batch.num_rows), pa.int32()),
                 pa.array(found.reshape(-1), pa.int32())], ["id", "v", "tree", "leaf"])

    placed = rows.mapInArrow(index, "id long, v array<double>, tree int, leaf int")
    counted = placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).toPandas()
    held = np.zeros((TREES, 1 << depth), dtype=np.int64)  # trees * leaves numbers
    held[counted["tree"], counted["leaf"]] = counted["n"]
    sizes = spark.sparkContext.broadcast(held)

    bits = 0
    while (BRANCH_ROWS << bits) < n and bits < depth:
        bits += 1

    def shares(count: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-count // BRANCH_ROWS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, body = batch.column(0).to_pylist(), matrix(batch.column(1).to_pylist())
            for lo in range(0, len(ids), 64):
                out: dict[tuple, list[int]] = {}
                for i, taken in enumerate(forest.value.probes(body[lo:lo + 64], sizes.value, search)):
                    for t, leaf in taken:
                        for s in range(int(shares(sizes.value[t, leaf]))):
                            out.setdefault((lo + i, t, leaf >> (depth - bits), s), []).append(leaf)
                if out:
                    at, tree, branch, share = (np.array(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                         pa.array(tree, pa.int32()), pa.array(branch, pa.int32()), pa.array(share, pa.int32()),
                         pa.array(list(out.values()), pa.list_(pa.int32()))],
                        ["id", "v", "tree", "branch", "share", "leaves"])

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            many = shares(sizes.value[pdf["tree"], pdf["leaf"]])
            yield pdf.assign(share=(pdf["id"].to_numpy() * 2654435761 % 4294967296 % many).astype("int32"),
                             branch=(pdf["leaf"].to_numpy() >> (depth - bits)).astype("int32"))

    def rerank(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "about": []}).astype(
            {"query_id": "int64", "vec_id": "int64"})
        if not len(q) or not len(x):
            return none
        asked, body = matrix(q["v"]), matrix(x["v"])
        width = max(body.shape[1], asked.shape[1])
        asked, body = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (asked, body))
        own, ids, leaf = q["id"].to_numpy(), x["id"].to_numpy(), x["leaf"].to_numpy()
        kept = least_copies(body, ids, k + 1)  # a query itself may be one of them
        body, ids, leaf = body[kept], ids[kept], leaf[kept]
        asked /= np.linalg.norm(asked, axis=1, keepdims=True)
        body /= np.linalg.norm(body, axis=1, keepdims=True)
        of_leaf: dict[int, list[int]] = {}
        for i, leaves in enumerate(q["leaves"]):
            for one in leaves:
                of_leaf.setdefault(int(one), []).append(i)
        at, found, score = [], [], []
        for one in np.unique(leaf):
            if (some := of_leaf.get(int(one))) is None:
                continue
            member, some = np.flatnonzero(leaf == one), np.array(some)
            scores = asked[some] @ body[member].T
            scores[own[some][:, None] == ids[member][None, :]] = -np.inf
            nth = max(len(member) - k, 0)
            edge = np.partition(scores, nth, axis=1)[:, nth]
            row, col = np.nonzero((scores >= edge[:, None] - NEAR) & (scores > -np.inf))
            at.append(some[row])
            found.append(ids[member][col])
            score.append(scores[row, col])
        if not at:
            return none
        out = pd.DataFrame({"query_id": own[np.concatenate(at)], "vec_id": np.concatenate(found),
                            "about": np.concatenate(score)})
        out = out.sort_values(["query_id", "about", "vec_id"], ascending=[True, False, True])
        first = out[out.groupby("query_id").cumcount() < k].groupby("query_id")["about"].min()
        return out[out["about"] >= out["query_id"].map(first) - NEAR]

    keys = ["tree", "branch", "share"]
    asked = rows.where(is_query).mapInArrow(
        probe, "id long, v array<double>, tree int, branch int, share int, leaves array<int>")
    dealt = placed.mapInPandas(deal, "id long, v array<double>, tree int, leaf int, share int, branch int")
    found = (asked.groupBy(*keys).cogroup(dealt.groupBy(*keys))
             .applyInPandas(rerank, "query_id long, vec_id long, about double")
             .groupBy("query_id", "vec_id").agg(F.max("about").alias("about")))
    near = Window.partitionBy("query_id").orderBy(F.desc("about"), "vec_id")
    edge = F.min(F.when(F.col("r") <= k, F.col("about"))).over(Window.partitionBy("query_id"))
    short = (found.withColumn("r", F.row_number().over(near)).withColumn("edge", edge)
             .where(F.col("about") >= F.col("edge") - F.lit(NEAR)).select("query_id", "vec_id"))
    zero = F.lit(0.0)
    q = rows.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    x = rows.select(F.col("id").alias("vec_id"), F.col("v").alias("xv"))
    qv, xv = F.col("qv"), F.col("xv")
    cosine = dot(qv, xv, zero) / (F.sqrt(dot(qv, qv, zero)) * F.sqrt(dot(xv, xv, zero)))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (short.join(x, "vec_id").join(q, "query_id").select("query_id", "vec_id", cosine.alias("score"))
            .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
