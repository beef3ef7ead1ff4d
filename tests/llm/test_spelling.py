"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tillkit.llm import spelling

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(docs):
    total = Counter()
    for i, text in docs:
        for w, n in Counter(r.translate(ASCII) for r in re.findall("[A-Za-zÀ-ÿ]+", text or "")).items():
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += n
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def expected(docs):
    words = counted(docs)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def found(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for c in ("word", "n", "key", "task"):  # clash with inner names
        df = df.selectExpr("*", f"'x' as {c}")
    rows = [tuple(r) for r in spelling.variants(df, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def sample(seed, letters, docs=40, words=150):
    r = random.Random(seed)
    stems = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(60)]
    out = []
    for i in range(docs):
        text = []
        for _ in range(words):
            w = r.choice(stems) if r.random() < 0.8 else r.choice(stems[:5])
            if r.random() < 0.5:
                k = r.randrange(len(w) + 1)
                w = r.choice([w[:k] + w[k + 1:], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1:]])
            text.append(w.upper() if r.random() < 0.1 else w)
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghÀÿ"])
def test_all_pairs_are_found(spark, letters):
    docs = sample(1, letters)
    assert found(spark, docs) == expected(docs)


@pytest.mark.parametrize("chunk", [2, 7])
def test_groups_cut_into_chunks(spark, chunk):
    """Every group above a chunk: chunks ask each other, no pair is lost or counted twice."""
    docs = sample(2, "ab")
    assert found(spark, docs, chunk=chunk, task=64) == expected(docs)


def test_chain_of_forms(spark):
    """Each word's form has a form of its own; a tie of counts takes the least word."""
    text = " ".join(["abcde"] * 3 + ["abcdf"] * 6 + ["abcgf"] * 12 + ["abhgf"] * 24 + ["zbcde"] * 6 + ["zzzzz"] * 2)
    docs = [(next(i for i in range(999) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in set(text.split()))), text)]
    got = found(spark, docs)
    assert got == expected(docs)
    by = {r[0]: r for r in got}
    assert by["abcde"][1:3] == ("abcdf", "abhgf") and "zzzzz" not in by


def test_pairs_that_share_both_halves_count_once(spark):
    docs = [(i, " ".join(["aaaaa"] * 9 + ["aaaaaa"] * 5 + ["aaaaaaa"] * 4 + ["abaaaa", "aaaaab"])) for i in range(4)]
    assert found(spark, docs) == expected(docs)


def test_slip_of_the_crc(spark):
    docs = [(i, "Hallöchen") for i in range(300)]
    got = {r[0]: r for r in found(spark, docs)}
    assert found(spark, docs) == expected(docs)
    assert got["hallöchen"][3] < 300
    assert spelling.slipped(5, "x") in ("x", "")


def test_nulls_empty_repeats_and_long_words(spark):
    long = "ab" * 60_000
    docs = [(None, "hello hello hello hellu hellu hellu"), (1, None), (2, ""), (2, "hello"), (2, "hello"), (3, "1 2 ß"),
            (4, f"{long} {long} {long} {long}c {long}c {long}c")]
    assert found(spark, docs) == expected(docs)
    assert found(spark, []) == set()


def test_scan_of_one_list():
    """The scan itself, ranges skipped and rows of the band reused, against every pair."""
    r = random.Random(5)
    parts = list({"".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(300)})
    group = np.array([len(p) % 2 for p in parts])
    asks = np.array([r.random() < 0.8 for _ in parts])
    lists = np.array([r.random() < 0.8 for _ in parts])
    i, j = spelling.near_in_lists(group, parts, asks, lists)
    want = {(a, b) for a in range(len(parts)) for b in range(len(parts))
            if asks[a] and lists[b] and group[a] == group[b] and one_edit(parts[a], parts[b])}
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(want)
