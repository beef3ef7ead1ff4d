"""Merkle manifest against one built in Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tillkit.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fan):
    """The node that remains, and the siblings of each leaf's way."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i:i + fan] for i in range(0, len(level), fan)]
        for j, place in enumerate(at):
            run, o = runs[place // fan], place % fan
            ways[j].append(("".join(run[:o]), "".join(run[o + 1:])))
            at[j] = place // fan
        level = [h("".join(r)) for r in runs]
    return level[0], ways


def expected(rows, claims, fan):
    groups = {}
    for row, claim in zip(rows, claims):
        groups.setdefault(row[2], []).append((row, claim))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        members = sorted(groups[g], key=lambda x: (x[0][0] is not None, x[0][0] or 0, leaf(x[0])))
        trees[g] = members, *tree([leaf(r) for r, _ in members], fan)
    root, top = tree([trees[g][1] for g in order], fan)
    out = []
    for g, way_up in zip(order, top):
        members, subroot, ways = trees[g]
        for (row, claim), way in zip(members, ways):
            folded = claim
            for left, right in way + way_up:
                folded = h(left + folded + right)
            out.append((row[0], leaf(row), subroot, root, h("".join(a + b for a, b in way + way_up)), folded,
                        folded == root))
    return sorted(out, key=str)


def audited(spark, rows, fan=merkle.FAN, **extra):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(v) for c, v in extra.items()})
    fields = [F.col(f) for f in merkle.FIELDS]
    out = merkle.audit(docs, merkle.digest(*fields[:-1], merkle.lower_ascii(F.col("text"))), fan=fan)
    return sorted((tuple(r) for r in out.collect()), key=str)


ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(rows):
    return [leaf((*r[:4], r[4].translate(ASCII) if r[4] is not None else None)) for r in rows]


def test_trees_of_every_height(spark):
    """Groups of 1, 8, 9, 64 and 70 leaves and a null group: heights 0 to 3."""
    rows = []
    for lang, n in ((None, 3), ("a", 1), ("b", 8), ("c", 9), ("é", 64), ("d", 70)):
        for i in range(n):
            rows.append((len(rows), f"s{i % 3}", lang, i, f"Text {i} É{lang}" if i % 5 else "plain"))
    assert audited(spark, rows) == expected(rows, lowered(rows), merkle.FAN)


def test_hot_group_and_narrow_runs(spark):
    """One group of most rows, runs of 3, and more groups than a run holds."""
    rows = [(i, None, "hot" if i % 3 else f"l{i % 21}", None, f"T{i}") for i in range(120)]
    assert audited(spark, rows, fan=3) == expected(rows, lowered(rows), 3)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (1, "s", "en", 0, ""), (1, "s", "en", 0, ""), (1, "s", "en", 1, "Z"),
            (None, "s", "en", 5, "A"), (2, "s", "en", 5, "Aß" * 300_000)]
    assert audited(spark, rows, kids="x", way="y", digest=1, tree=2, lo=3) == expected(rows, lowered(rows), merkle.FAN)


def test_one_row_and_empty_table(spark):
    row = (7, "s", "en", 1, "A")
    (got,) = audited(spark, [row])
    assert got[1:4] == (leaf(row), leaf(row), leaf(row)) and got[4] == h("") and got[6] is False
    assert audited(spark, []) == []


def test_no_field_can_be_moved_into_another(spark):
    rows = [(1, "a", "b", None, "c"), (1, "a1:b", None, None, "c"), (1, "-", "b", None, "c")]
    found = spark.createDataFrame(rows, SCHEMA).select(merkle.digest(*[F.col(f) for f in merkle.FIELDS]).alias("d"))
    assert len({r.d for r in found.collect()}) == 3


@pytest.mark.parametrize("field", range(5))
def test_any_changed_field_is_found(spark, field):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(20)]
    other = (99, "z", "zz", 98, "u")
    docs = spark.createDataFrame(rows, SCHEMA)
    cols = [F.when(F.col("doc_id") == 11, F.lit(other[k])).otherwise(F.col(f)) if k == field else F.col(f)
            for k, f in enumerate(merkle.FIELDS)]
    out = merkle.audit(docs, merkle.digest(*cols)).collect()
    assert {r.key for r in out if not r.verified} == {11}
