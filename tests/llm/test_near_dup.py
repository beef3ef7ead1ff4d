import random
from collections import Counter

import numpy as np
import pytest

from tillkit.llm import near_dup
from tillkit.llm.components import connected
from tillkit.llm.order_minhash import aligned


def shingles(text, k=5):
    w = text.lower().split()
    k = min(k, len(w)) or 1
    return [tuple(w[i:i + k]) for i in range(len(w) - k + 1)] if w else []


def similarity(a, b):
    """Longest common subsequence of occurrence-labelled shingles over their union."""
    def labelled(s):
        seen = Counter()
        out = []
        for x in s:
            seen[x] += 1
            out.append((x, seen[x]))
        return out

    a, b = labelled(shingles(a)), labelled(shingles(b))
    if not a or not b:
        return 0.0
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(last[j] + 1 if x == y else max(last[j + 1], now[j]))
        last = now
    return last[-1] / (len(a) + len(b) - last[-1])


def groups(rows, least=0.8):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a is not None and b is not None and (a == b or similarity(a, b) >= least):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least_id = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least_id[r] = min(least_id.get(r, d), d)
    return [least_id[find(i)] for i in range(len(rows))]


def corpus(seed, families=8, copies=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    passage = [word() for _ in range(40)]
    texts = [None, None, "", "", "one", "one", "One", "two words", "  ", "a " * 300]
    for _ in range(families):
        base = [word() for _ in range(rng.randint(60, 150))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(copies):
            new = list(base)
            for _ in range(rng.randint(0, 6)):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
        texts.append(" ".join(base))
        texts.append(" ".join(base))
    return list(enumerate(texts))


@pytest.mark.parametrize("crowd", [32, 3])
def test_groups_equal_brute_force(frame, crowd):
    rows = corpus(crowd)
    docs = frame(rows, "doc_id long, text string", {"t1": 1, "root": "r", "kept": 0})
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, crowd=crowd).collect()}
    want = groups(rows)
    assert [got[i].group_id for i, _ in rows] == want
    assert [got[i].kept for i, _ in rows] == [g == i for (i, _), g in zip(rows, want)]
    sizes = Counter(want)
    assert all(got[i].group_size == sizes[g] for (i, _), g in zip(rows, want))
    left = near_dup.drop_near_duplicates(docs, crowd=crowd)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({g for g in want})


def brief(seed):
    """Bases of 1 to 32 words with a word added, cut or changed, and a phrase that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    phrase = [word() for _ in range(12)]
    texts = []
    for n in [8, 9, 10] * 4 + list(range(1, 33)):
        base = [word() for _ in range(n)]
        texts += [base, [word(), *base], [*base, word()], base[1:], base[:-1], [*base[:-1], word()],
                  [*base, word(), word()], phrase + base[:n % 4], base[:n % 5] + phrase]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("crowd", [32, 3])
def test_brief_texts_equal_brute_force(frame, crowd):
    rows = brief(crowd)
    for i in (0, 9, 18):  # 8 and 9, 9 and 10, 10 and 11 words
        assert similarity(rows[i][1], rows[i + 1][1]) >= 0.8
    got = {r.doc_id: r.group_id for r in near_dup.near_duplicates(
        frame(rows, "doc_id long, text string", {"s": 1, "f": 2}), crowd=crowd).collect()}
    assert [got[i] for i, _ in rows] == groups(rows)


def test_repeated_rows_and_null_ids(frame):
    text = " ".join(f"w{i}" for i in range(30))
    docs = frame([(3, text), (3, text), (None, text), (5, None), (5, None)], "doc_id long, text string")
    kept = near_dup.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.text is None) for r in kept) == [(3, False), (5, True), (5, True)]
    assert near_dup.near_duplicates(docs).count() == 5


def test_empty_table(frame):
    docs = frame([], "doc_id long, text string")
    assert near_dup.near_duplicates(docs).collect() == []
    assert near_dup.drop_near_duplicates(docs).collect() == []


def test_alignment_keeps_order():
    a = np.arange(100, dtype=np.uint64)
    assert aligned(a, a, 0.8) == 1.0
    assert aligned(a, np.concatenate([a[50:], a[:50]]), 0.8) == 0.0
    assert aligned(a, np.concatenate([a[:95], a[95:] + np.uint64(500)]), 0.8) == 95 / 105
    assert aligned(a, a[:10], 0.8) == 0.0


def test_components(frame):
    links = frame([(1, 2), (2, 3), (9, 8), (7, 8), (4, 4)] + [(20 + i, 21 + i) for i in range(30)], "a long, b long")
    got = {r.node: r.root for r in connected(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{20 + i: 20 for i in range(31)}}
