import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillkit.llm import rp_forest, topk_search
from tillkit.llm.common import read
from tillkit.llm.vectors import best

IS_QUERY = "id % 5 = 0"
SCHEMA = "vec_id long, embedding array<float>"


def rows(n, dims, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype("float32")
    x[n // 3:n // 2] = x[0]  # many copies
    return [(i, v.tolist()) for i, v in enumerate(x)]


ODD = [(1000, None), (1005, [1.0, None]), (1010, [float("nan"), 1.0]), (1015, [float("inf"), 1.0]), (None, [1.0]),
       (1020, [])]


def brute(data, k):
    ints = {i: [int(np.floor(256 * float(np.float32(e)))) for e in v] for i, v in data}
    out = []
    for q in sorted(i for i in ints if i % 5 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("n,dims,blocks", [(70, 7, (16, 4)), (4, 3, (8192, 2048)), (1, 2, (8192, 2048))])
def test_top_k_equals_brute_force(frame, monkeypatch, n, dims, blocks):
    monkeypatch.setattr(topk_search, "ROWS", blocks[0])
    monkeypatch.setattr(topk_search, "QUERIES", blocks[1])
    data = rows(n, dims, n)
    vectors = frame(data + data[:2] + ODD, SCHEMA, {"id": "clash", "rank": 1})
    got = topk_search.top_k(vectors, IS_QUERY)
    assert sorted(tuple(r) for r in got.collect()) == brute(data, 5)


def test_exact_beyond_double():
    big = np.array([[2 ** 30 + 1, 1]])
    assert int(topk_search._local(big, big)[0, 0]) == (2 ** 30 + 1) ** 2 + 1


def test_scores_beyond_double_end_to_end(spark):
    """Components around 2**27 after scaling: sums above 2**53, and a near tie that doubles cannot tell."""
    a, b = float(2 ** 19 + 3), float(2 ** 18 + 1)
    data = [(0, [a, b]), (1, [a, b]), (2, [a, b + 1 / 256]), (3, [a + 1 / 256, b]), (4, [-a, -b]), (5, [-a, b])]
    got = topk_search.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("id") == 0, k=5).collect()
    whole = {i: [int(x * 256) for x in v] for i, v in data}
    want = sorted(((-sum(x * y for x, y in zip(whole[0], v)), i) for i, v in whole.items() if i), )[:5]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, -s) for s, i in want]


def test_forest_on_small_tables(frame):
    data = rows(60, 6, 5)
    got = rp_forest.nearest(frame(data + data[:2] + ODD + [(2000, [0.0] * 6)], SCHEMA, {"id": 1}), IS_QUERY).collect()
    x = {i: np.array(v, dtype=float) for i, v in data}
    for q in (i for i in x if i % 5 == 0):
        cos = {i: float(x[q] @ v / np.sqrt((x[q] @ x[q]) * (v @ v))) for i, v in x.items() if i != q}
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        want = sorted(cos.values(), reverse=True)[:5]
        assert np.allclose([r.score for r in own], want, atol=1e-12)
        assert all(abs(cos[r.vec_id] - r.score) < 1e-12 for r in own)


def test_forest_recall(spark):
    d = "/root/testdata/sf0.1"
    got = {(r.query_id, r.vec_id) for r in
           rp_forest.nearest(read(spark, d, "embeddings"), F.col("id") % 50 == 0).collect()}
    table = read(spark, d, "embeddings").toPandas()
    x = np.array(table["embedding"].tolist(), dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = table["vec_id"].to_numpy()
    q = np.flatnonzero(ids % 50 == 0)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -2
    truth = {(int(ids[a]), int(ids[b])) for a, near in zip(q, np.argsort(-scores, axis=1)[:, :5]) for b in near}
    assert len(got & truth) >= 0.9 * len(truth)


def test_forest_recall_of_middle_size(frame):
    x = np.random.default_rng(8).normal(size=(8000, 64))
    got = {(r.query_id, r.vec_id) for r in rp_forest.nearest(
        frame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), F.col("id") % 80 == 0).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.arange(0, 8000, 80)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -2
    truth = {(int(a), int(b)) for a, near in zip(q, np.argsort(-scores, axis=1)[:, :5]) for b in near}
    assert len(got & truth) >= 0.94 * len(truth)


def test_hot_leaf_is_dealt(frame, monkeypatch):
    monkeypatch.setattr(rp_forest, "BRANCH_ROWS", 8)
    data = [(i, [1.0, 2.0]) for i in range(40)] + [(40 + i, [float(i), 1.0]) for i in range(5)]
    got = rp_forest.nearest(frame(data, SCHEMA), "id = 3", search=1000).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2, 4, 5]


def test_empty_tables(frame):
    none = frame([], SCHEMA)
    assert topk_search.top_k(none, IS_QUERY).collect() == []
    assert rp_forest.nearest(none, IS_QUERY).collect() == []


def test_best_breaks_ties_by_id():
    random.seed(2)
    scores = np.array([[random.randint(0, 3) for _ in range(20)] for _ in range(30)], dtype=float)
    ids = np.array(random.sample(range(100), 20))
    row, col = best(scores, ids, 4)
    for i in range(30):
        want = sorted(range(20), key=lambda j: (-scores[i, j], ids[j]))[:4]
        assert col[row == i].tolist() == want


def test_forest_ties_of_copies_go_to_the_least_ids(frame):
    rng = np.random.default_rng(4)
    x, kind = rng.normal(size=(30, 64)), rng.permutation(np.repeat(np.arange(30), 50))
    rows = [(i, x[c].tolist()) for i, c in enumerate(kind)]
    got = rp_forest.nearest(frame(rows, "vec_id long, embedding array<double>"), F.lit(True)).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {q: [int(i) for i in np.flatnonzero(kind == c) if i != q][:5] for q, c in enumerate(kind)}
