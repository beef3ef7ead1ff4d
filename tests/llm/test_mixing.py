import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tillkit.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, share=1.5, weights=(5, 2, 1), most=2.0):
    """Targets by capping and sharing again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        goal = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if goal[s] >= most * sizes[s]}
        if not over:
            return goal | {s: most * sizes[s] for s in capped}
        capped |= over


def rows(n=600):
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        source = None if i % 31 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}é"
        out.append((i, " ".join(["wörd"] * int(rng.integers(0, 40))) + "\t\x0b\n", source))
    return out + [(9999, None, "nothing"), (None, "a b", "s1é"), (5, "same row", "hot"), (5, "same row", "hot")]


def test_targets_and_taken(frame):
    data = rows()
    docs = frame(data, "doc_id long, text string, source string", {"size": "x", "t1": 1, "place": 2})
    got = mixing.mix(docs, block_words=200, shard_blocks=4).collect()
    assert len(got) == len(data)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(WORD.findall(t or ""))
    goal = water(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r["size"] * len(r.shards)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in goal)
    assert sorted(tuple(r) for r in got if r.doc_id) == sorted(
        tuple(r) for r in mixing.mix(docs, block_words=200, shard_blocks=4).collect() if r.doc_id)
    shards = {s for r in got for s in r.shards}
    assert len(shards) > 3 and max(shards) < 256


def test_documents_of_the_mix(frame):
    docs = frame(rows(), "doc_id long, text string, source string", {"shard": 3})
    plan = mixing.mix(docs).collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(len(r.shards) for r in plan)


def test_empty_table(frame):
    docs = frame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == []
    assert mixing.mixed_documents(docs).collect() == []


def test_tree_keeps_quotas_and_spreads(spark):
    quotas = spark.createDataFrame([([1000, 0, 37, 1],)], "quotas array<long>")
    got = mixing.tree(quotas, 4).collect()
    total, shard = defaultdict(int), defaultdict(int)
    for r in got:
        total[r.place] += r.quota
        shard[r.shard] += r.quota
        assert r.quota >= 0
    assert total == {0: 1000, 1: 0, 2: 37, 3: 1}
    assert len(shard) == 16 and max(shard.values()) - min(shard.values()) <= 1


def test_hypergeometric_has_the_right_mean_and_spread(spark):
    n, good, draws = 60, 25, 30
    df = spark.range(4000).select(
        mixing._hypergeometric(F.lit(n).cast("long"), F.lit(good).cast("long"), F.lit(draws).cast("long"),
                               mixing._uniform(F.col("id"))).alias("x"))
    mean, spread = df.agg(F.avg("x"), F.stddev("x")).first()
    p = good / n
    assert abs(mean - draws * p) < 0.15
    assert abs(spread - (draws * p * (1 - p) * (n - draws) / (n - 1)) ** 0.5) < 0.1
