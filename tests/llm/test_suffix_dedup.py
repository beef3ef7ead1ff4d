import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillkit.llm import suffix_dedup
from tillkit.llm.suffix_array import common_prefixes, suffix_array


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_array_sorts(text):
    order = suffix_array(text)
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    for k, n in enumerate(common_prefixes(text, order)):
        if k:
            a, b = text[order[k - 1]:], text[order[k]:]
            assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute(bodies, length):
    seen = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(g and not p for p, g in zip(b"\0" + gone, gone))
        out.append((bytes(x for x, g in zip(b, gone) if not g), runs))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(4)]
    texts = [None, "", "x", "ab" * 400, "q" * 500, passage[0] * 3]
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.randint(0, 60)))
        for p in passage:
            if rng.random() < 0.3:
                cut = rng.randint(0, len(p) // 2)
                t = t + p[cut:] + word() if rng.random() < 0.5 else p + t
        texts.append(t)
        if rng.random() < 0.2:
            k = rng.randrange(len(t) + 1)
            texts.append(t[:k] + word() + t[k:])
    return texts + texts[:9]


@pytest.mark.parametrize("length,most", [(40, 8192), (40, 2), (200, 8192)])
def test_equals_brute_force(frame, length, most):
    texts = corpus(length + most)
    rows = [(i % (len(texts) - 5), t) for i, t in enumerate(texts)]
    docs = frame(rows, "doc_id long, text string", {"t1": 5, "spans": "x", "kept": "mine"})
    got = suffix_dedup.remove_repeats(docs, length=length, most=most)
    assert got.columns == [*docs.columns, "_kept", "n_bytes", "n_removed", "n_spans"]
    found = Counter((r.doc_id, r.text, bytes(r._kept), r.n_bytes, r.n_removed, r.n_spans, r.t1, r.spans, r.kept)
                    for r in got.collect())
    bodies = [(t or "").encode() for t in texts]
    want = Counter((i, t, left, len(b), len(b) - len(left), runs, 5, "x", "mine")
                   for (i, t), b, (left, runs) in zip(rows, bodies, brute(bodies, length)))
    assert found == want


def test_empty_table(frame):
    docs = frame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).collect() == []


def test_digest(frame):
    docs = frame([(1, "a"), (None, None)], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs).select("doc_id", suffix_dedup.sha256("kept").alias("d")).collect()
    assert {r.doc_id: r.d for r in got} == {1: hashlib.sha256(b"a").hexdigest(), None: hashlib.sha256(b"").hexdigest()}
