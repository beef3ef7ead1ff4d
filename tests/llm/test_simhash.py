"""SimHash groups against every pair of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tillkit.llm import simhash

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, most=3):
    """Least place of each fingerprint's component."""
    a, root = np.array(fps, dtype=np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1:]) <= most) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def near(r, fp, bits):
    for b in r.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


@pytest.mark.parametrize("chunk", [2, 16, 1024])
def test_links_of_planted_fingerprints(spark, chunk):
    """Random ones, partners at 1 to 6 bits, a dense group around one, and zero."""
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(300)} | {0, 1 << 63, (1 << 64) - 1}
    fps |= {near(r, f, k) for f in list(fps)[:120] for k in (1, 2, 3, 4, 5, 6)}
    fps |= {near(r, 0xF0F0F0F0F0F0F0F0, k) for k in (1, 2, 3, 2, 2) for _ in range(60)}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = simhash.links(df, chunk=chunk).collect()
    place = {signed(f): i for i, f in enumerate(fps)}
    edges = [(place[x.a], place[x.b]) for x in found]
    want = components(fps)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(fps))] == want


def test_links_do_not_grow_with_the_square_of_a_group(spark):
    r = random.Random(4)
    bases = [r.getrandbits(64) & ~0xFFF for _ in range(2)]
    fps = [b | low for b in bases for low in range(4096)]  # 298 links of each: 1.2 million pairs
    assert simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).count() < 20 * len(fps)


def test_three_bits_in_any_place(spark):
    """Each way to spread 3 bits over the halves, and 4 bits, which do not link."""
    base = 0x123456789ABCDEF0
    for flips, linked in (((0, 1, 2), 1), ((0, 1, 40), 1), ((0, 40, 41), 1), ((31, 32, 63), 1), ((0, 1, 40, 41), 0)):
        other = base
        for b in flips:
            other ^= 1 << b
        df = spark.createDataFrame([(signed(base),), (signed(other),)], "fp long")
        assert simhash.links(df).count() == linked


def texts():
    r = random.Random(7)
    vocab = ["w%d" % i for i in range(400)] + ["Überfluß", "ÉTÉ"]
    out = []
    for i in range(60):
        words = [r.choice(vocab) for _ in range(r.choice((1, 2, 3, 8, 200, 900)))]
        out.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            copy[r.randrange(len(copy))] = "edited"
            out.append(r.choice((" ", "\n", "\t ", "  ")).join(copy))
        out.append(" ".join(words).upper())
    return out


def check(spark, rows, **extra):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in extra.items()})
    out = simhash.simhash_groups(docs).select("doc_id", simhash.hex_digits().alias("f"), "component_id").collect()
    fps = [fingerprint(t) for _, t in rows]
    roots = components(fps)
    least = {}
    for (i, _), x in zip(rows, roots):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    want = sorted(((i, format(f, "016x"), least.get(x)) for (i, _), f, x in zip(rows, fps, roots)), key=str)
    assert sorted((tuple(x) for x in out), key=str) == want


def test_documents(spark):
    check(spark, [(i * 7 % 301, t) for i, t in enumerate(texts())])


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(5, None), (3, ""), (4, " \t\x0b"), (3, "a b c d"), (3, "a b c d"), (None, "x y z"), (None, None), (9, "A B C D"),
            (8, " "), (1, "one"), (2, "one two")]
    check(spark, rows, fp="a", node=1, root=2, s=3, v="b")
    check(spark, [])


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"Wort{i % 977}ß" for i in range(30_000)) + "x" * 5_000 + "  end"
    whole = fingerprint(text)
    for piece in (7, 100, 5_000, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text) == whole
