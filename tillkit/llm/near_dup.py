"""Near-duplicate groups by Order MinHash and banded alignment.

Two texts are linked if an order-keeping alignment of their shingles of five
words (lower case, split at white space) matches 0.8 or more of all shingles
(``order_minhash.aligned``; with the same order this is their Jaccard
similarity). Groups are the connected components of the links.

1. Texts are taken once each: copies share the hash of the text.
2. Each text gets ``HASHES`` Order MinHash sketches: the ``TAKE`` least
   occurrence-labelled shingles under one order, kept in the order of the
   text. Texts that share a sketch are candidates. At similarity 0.8 one
   sketch of long texts is shared with probability 0.8**5; all 32 miss with
   3e-6, and with 1.2e-5 at worst for shorter ones (24 of 30 shingles shared).
   Texts of up to ``BRIEF`` shingles have no sketches: they and all texts that
   can reach the similarity to one share a shingle of their prefix, the
   rarest ones that a partner cannot all lack. So these pairs are exact.
3. The least text of each bucket (a sketch or prefix shingle that several texts
   share) is aligned with the others. That joins most of a group at the cost of
   one pair per text and bucket; a pair whose texts are joined already changes
   no group and is not compared again.
4. Buckets that still hold several components: up to ``CROWD`` texts give all
   pairs of different components (of lengths that can reach the similarity),
   which are aligned in tasks. The texts of a more crowded one are dealt into
   chunks of about ``CHUNK``, and every two chunks with several components meet
   in a task. It counts the shingles that any two texts share by one matrix
   product and aligns those pairs of different components that can reach the
   similarity. So every candidate pair is aligned or joined already: the
   groups are those of all links, and no task holds more than two chunks.
5. Links give components by star rounds.

Null texts are in no group but their own; a text without a word only equals
its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillkit.llm.common import Powers, free_names, ship, staged, text_key
from tillkit.llm.components import connected
from tillkit.llm.order_minhash import aligned, shingles, sketch, word_hashes

WORDS = 5
SIMILARITY = 0.8
HASHES, TAKE = 32, 5
#: Shingles up to which a text meets its partners by prefixes alone.
BRIEF = 4 * TAKE
CROWD = 32
CHUNK = 256
#: Shingles in a matrix product at a time.
COLUMNS = 16384


def _shingles(text: str, words: int, pw: Powers) -> np.ndarray:
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return shingles(word_hashes(data, pw), words)


def _longest(least: float) -> int:
    """Shingles of the longest text that can reach ``least`` to one of ``BRIEF``."""
    return int(BRIEF / least + 1e-9)


def _sketches(texts: DataFrame, keys: list[str], hashes: int, take: int, words: int, least: float) -> DataFrame:
    """``keys`` (long), n (shingles), the sketches and the brief of each row's text.

    The brief is all shingles of a text of up to ``_longest`` ones.
    """
    longest = _longest(least)
    none = np.empty(0, np.int64)

    def lists(found: list[np.ndarray]) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        flat = np.concatenate(found) if found else none
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = Powers()
        for batch in batches:
            found, brief, counts = [], [], []
            for t in batch.column("text").to_pylist():
                labelled = _shingles(t, words, pw)
                counts.append(len(labelled))
                found.append(sketch(labelled, hashes, take) if len(labelled) > BRIEF else none)
                brief.append(labelled.view(np.int64) if len(labelled) <= longest else none)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys] + [pa.array(counts, pa.int64()), lists(found), lists(brief)],
                [*keys, "n", "sketches", "brief"])

    kinds = ", ".join(f"{k} long" for k in keys)
    return texts.select(*keys, "text").mapInArrow(run, f"{kinds}, n long, sketches array<long>, brief array<long>")


def _prefixes(sketched: DataFrame, least: float) -> DataFrame:
    """(s, node, n): the prefix shingles of each brief.

    Two texts of ``least`` share at least ceil(least * n) shingles of each, so
    they share one of the first n - ceil(least * n) + 1 in any common order.
    Rare ones come first: a phrase of many texts brings few of them together.
    """
    rows = sketched.select(F.explode("brief").alias("s"), "node", "n")
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    ranked = rows.join(often, "s").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("x"))
    first = (F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1).cast("int")
    return (ranked.select("node", "n", F.explode(F.slice("x", F.lit(1), first)).alias("x"))
            .where("x.f > 1").select(F.col("x.s").alias("s"), "node", "n"))


def _buckets(sketched: DataFrame, least: float) -> DataFrame:
    """(s, node, n, size, lead) of every sketch or prefix shingle that several nodes share."""
    rows = sketched.select(F.explode("sketches").alias("s"), "node", "n").unionByName(_prefixes(sketched, least))
    shared = rows.groupBy("s").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead")).where("size > 1")
    return rows.join(shared, "s")


def _stars(buckets: DataFrame, sketched: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b) of the least node of each bucket with its other ones."""
    lead = sketched.select(F.col("node").alias("lead"), F.col("n").alias("m"))
    first = buckets.where("node <> lead").select(F.col("node").alias("b"), "lead", "n").distinct()
    return (first.join(lead, "lead").where(F.least("n", "m") >= F.lit(least) * F.greatest("n", "m"))
            .select(F.col("lead").alias("a"), "b"))


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets that hold texts of several components, with ``root``."""
    tagged = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = tagged.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("s")
    return tagged.join(several, "s")


def _pairs(buckets: DataFrame, least: float, crowd: int) -> DataFrame:
    """All candidate pairs (a < b) of different components in buckets of up to ``crowd`` texts."""
    small = buckets.where(F.col("size") <= crowd).select("s", F.col("node").alias("a"), "n", "root")
    other = small.select("s", F.col("a").alias("b"), F.col("n").alias("m"), F.col("root").alias("q"))
    return (small.join(other, (small["s"] == other["s"]) & (F.col("a") < F.col("b")) & (F.col("root") != F.col("q"))
                       & (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")))
            .select("a", "b").distinct())


def _links_of(one: list[tuple], two: list[tuple], least: float) -> list[tuple[int, int]]:
    """Links between texts (node, shingles, root) of two chunks, or within one (``two`` empty).

    Only links that join what is not joined yet: roots that a link has met
    count as one from then on.
    """
    both = one + two
    _, place = np.unique(np.concatenate([x[1] for x in both]), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(x[1]) for x in both])
    shared = np.bincount(place, minlength=1)[place] > 1  # a shingle of one text alone joins nothing
    _, place = np.unique(place[shared], return_inverse=True)
    row, order = row[shared], np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    common = np.zeros((len(one), len(two or one)))
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        at = slice(*np.searchsorted(place, [lo, lo + COLUMNS]))
        table = np.zeros((len(both), COLUMNS), dtype=np.float32)
        table[row[at], place[at] - lo] = 1.0
        common += table[:len(one)] @ (table[len(one):] if two else table).T
    size = np.array([len(x[1]) for x in both], dtype=float)
    sizes = (size[:len(one)], size[len(one):]) if two else (size, size)
    need = least / (1 + least) * (sizes[0][:, None] + sizes[1][None, :]) - 1e-6
    top = {x[2]: x[2] for x in both}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(common >= need)):
        a, b = one[i], (two or one)[j]
        if a[0] != b[0] and (two or i < j) and root(a[2]) != root(b[2]) and aligned(a[1], b[1], least) >= least - 1e-12:
            top[root(a[2])] = root(b[2])
            out.append((min(a[0], b[0]), max(a[0], b[0])))
    return out


def _crowd_links(buckets: DataFrame, bodies: DataFrame, least: float, words: int, crowd: int,
                 chunk: int) -> DataFrame:
    """Links (a, b) that join components among the texts of crowded buckets."""
    deal = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    members = (buckets.where(F.col("size") > crowd)
               .withColumn("chunks", F.ceil(F.col("size") / chunk)).withColumn("c", deal)
               .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
               .select("s", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "node", "root"))
    several = members.groupBy("s", "i", "j").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    members = members.join(several.select("s", "i", "j"), ["s", "i", "j"])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pw = Powers()
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        body = [(int(c), (int(n), _shingles(t, words, pw), int(r)))
                for n, c, t, r in zip(pdf["node"], pdf["c"], pdf["text"], pdf["root"])]
        one = [x for c, x in body if c == i]
        two = [x for c, x in body if c == j] if i != j else []
        found = _links_of(one, two, least) if one and (two or i == j) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return members.join(bodies, "node").groupBy("s", "i", "j").applyInPandas(task, "a long, b long")


def _verify(pairs: DataFrame, bodies: DataFrame, least: float, words: int) -> DataFrame:
    """Pairs whose texts align to ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = Powers()
        kept: dict[int, np.ndarray] = {}

        def body(node: int, text: str) -> np.ndarray:
            if node not in kept:
                if len(kept) >= 64:
                    kept.pop(next(iter(kept)))
                kept[node] = _shingles(text, words, pw)
            return kept[node]

        for batch in batches:
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "ta", "tb"))
            good = [aligned(body(x, ta[i].as_py()), body(y, tb[i].as_py()), least) >= least - 1e-12
                    for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist()))]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = bodies.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    second = bodies.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(second, "b").join(first, "a").mapInArrow(run, "a long, b long")


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                     least: float = SIMILARITY, crowd: int = CROWD,
                     chunk: int = CHUNK) -> DataFrame:
    """Group of every different text: (t1, t2, root).

    t1 and t2 are the hashes of the text (``common.text_key``), root names the
    group.
    """
    ship(docs.sparkSession)
    texts = docs.where(F.col(text).isNotNull()).select(*text_key(text), F.col(text).alias("text"))
    once = _sketches(texts, ["t1", "t2"], HASHES, TAKE, words, least).groupBy("t1", "t2").agg(
        F.first("n").alias("n"), F.first("sketches").alias("sketches"), F.first("brief").alias("brief"))
    sketched = staged(once.withColumn("node", F.monotonically_increasing_id()), "sketches")
    shared = staged(_buckets(sketched, least), "buckets")
    seen = shared.select("node").distinct().join(sketched.select("node", "t1", "t2"), "node")
    bodies = staged(texts.join(seen, ["t1", "t2"]).groupBy("node").agg(F.first("text").alias("text")), "bodies")
    # first the least text of each bucket with the others; what that joins needs no more comparing
    first = staged(_verify(_stars(shared, sketched, least), bodies, least, words), "stars")
    left = staged(_open(shared, connected(first)), "open")
    more = _verify(_pairs(left, least, crowd), bodies, least, words).unionByName(
        _crowd_links(left, bodies, least, words, crowd, chunk))
    roots = connected(first.unionByName(more))
    return (sketched.select("node", "t1", "t2").join(roots, "node", "left")
            .select("t1", "t2", F.coalesce("root", "node").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                    least: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: doc_id, group_id, group_size, kept.

    group_id is the least doc_id of the group; rows that repeat a doc_id are
    rows of their own. ``kept`` marks the rows with that id and the least text
    hash among them.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).isNull().alias("bare"), *text_key(text))
    groups = duplicate_groups(docs, doc_id, text, words, least, crowd)
    per_text = (texts.where(~F.col("bare")).groupBy("t1", "t2")
                .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")))
    named = staged(groups.join(per_text, ["t1", "t2"]), "groups")
    total = named.groupBy("root").agg(
        F.min(F.struct("first", "t1", "t2")).alias("best"), F.min("first").alias("group_id"),
        F.sum("rows").alias("group_size"))
    each = named.join(total, "root").select(
        "t1", "t2", "group_id", "group_size",
        ((F.col("t1") == F.col("best.t1")) & (F.col("t2") == F.col("best.t2"))).alias("lead"))
    grouped = texts.where(~F.col("bare")).join(each, ["t1", "t2"]).select(
        "doc_id", "group_id", "group_size",
        (F.col("lead") & F.col("doc_id").eqNullSafe(F.col("group_id"))).alias("kept"))
    alone = texts.where("bare").select(
        "doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                         least: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """``docs`` with one row of each group: least doc_id, then least text hash.

    Rows without a text stay. Repeated rows of the kept id and text count as
    copies of each other: one stays.
    """
    t1, t2, keep_id, tie = free_names(docs, "t1", "t2", "group_id", "repeats")
    groups = duplicate_groups(docs, doc_id, text, words, least, crowd)
    ids = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), *text_key(text))
    per_text = (ids.groupBy("t1", "t2", "id").agg(F.count(F.lit(1)).alias("rows"))
                .groupBy("t1", "t2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rows")).alias("least")))
    named = groups.join(per_text, ["t1", "t2"])
    winners = staged(
        named.groupBy("root").agg(F.min(F.struct("least.none", "least.id", "t1", "t2", "least.rows")).alias("w"))
        .select(F.col("w.t1").alias(t1), F.col("w.t2").alias(t2), F.col("w.id").alias(keep_id),
                F.col("w.rows").alias(tie)), "winners")
    k1, k2 = text_key(text)
    keyed = docs.where(F.col(text).isNotNull()).select("*", k1.alias(t1), k2.alias(t2))
    kept = keyed.join(winners, [t1, t2]).where(F.col(doc_id).eqNullSafe(F.col(keep_id)))
    single = kept.where(F.col(tie) == 1)
    repeated = kept.where(F.col(tie) > 1).dropDuplicates([t1, t2])
    bare = docs.where(F.col(text).isNull())
    return single.unionByName(repeated).select(*docs.columns).unionByName(bare)
