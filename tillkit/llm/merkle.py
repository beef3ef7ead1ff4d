"""Merkle manifest of a table, with proofs of single rows.

Every row is a leaf: the SHA-256 of its fields, each with its length in front.
The leaves of a group, ordered by key, stand in runs of ``FAN``; a run becomes
the digest of its members' digests until one node, the group's subroot, is
left. The subroots, ordered by group, give the root in the same way.

Nested intervals: a node at level k covers the leaf ranks [lo, hi), so no node
holds a pointer to another.

1. Leaves are ranked by a range partitioning with offsets
   (``numbering.sequence_within``), so a group with most of the rows is many
   tasks.
2. Going up, a level is one aggregation by (tree, lo div FAN**k) of at most
   ``FAN`` digests; levels shrink by ``FAN`` and are written as they are read
   twice.
3. Going down, a level meets the one above by containment of intervals within
   the bucket lo div FAN**k. What the parent's interval holds beside the node's
   own are its siblings; they stand in front of those of the parent. So a node
   carries the siblings of its whole way to the root, and leaves are joined once.

No step gathers more than ``FAN`` nodes, whatever the size of a group.

Defined cases: null fields count as ``-``; a null group is a group of its own,
before all others; null keys come before all others; rows that repeat a key
are ordered by their digest; an empty table has no rows and no root; a lone
leaf is its group's subroot, and its way has no siblings below it. Columns
other than the fields are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillkit.llm.common import staged
from tillkit.operators.numbering import sequence_within

FAN = 8
#: Ranks of a group that meet its size under one key.
STRIPE = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    """``levels[k]``: nodes (tree, size, lo, hi, digest, kids) of level k of the groups'
    trees, level 0 the leaves; ``top``: the same of the tree over the subroots."""

    levels: list[DataFrame]
    top: list[DataFrame]
    fan: int


def digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields, each as its UTF-8 length, ``:`` and itself (null: ``-``)."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def leaves(docs: DataFrame, leaf: Column, group: str = "lang", key: str = "doc_id",
           **more: Column) -> DataFrame:
    """(tree, key, digest, and ``more``) of every row; ``tree`` sorts as the group does, null first."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf.alias("digest"),
                       *[c.alias(n) for n, c in more.items()])


def _ranked(nodes: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, int]:
    """``nodes`` with the interval of their rank and the size of their tree; the greatest size."""
    placed = staged(sequence_within(nodes, group, order, "hi").withColumn("lo", F.col("hi") - 1), "ranks")
    sizes = staged(placed.groupBy(*group).agg(F.max("hi").alias("size")), "sizes")
    most = sizes.agg(F.max("size")).first()[0] or 0
    if not group:
        return placed.withColumn("size", F.lit(most).cast("long")), most
    # a size for each stripe of ranks: a group with most of the rows is many keys of the join
    striped = sizes.withColumn("stripe", F.explode(F.expr(f"sequence(0, (size - 1) div {STRIPE})")))
    return placed.withColumn("stripe", F.expr(f"lo div {STRIPE}")).join(striped, [*group, "stripe"]).drop("stripe"), most


def _above(nodes: DataFrame, level: int, fan: int) -> DataFrame:
    """Nodes of ``level`` over those of the level below, in trees that have several there."""
    width = fan ** level
    kid = F.struct("lo", "hi", "digest")
    runs = (nodes.where(F.col("size") > width // fan)
            .groupBy("tree", "size", F.expr(f"lo div {width}").alias("bucket"))
            .agg(F.sort_array(F.collect_list(kid)).alias("kids")))
    return runs.select("tree", "size", F.col("kids")[0]["lo"].alias("lo"),
                       F.element_at("kids", -1)["hi"].alias("hi"),
                       F.sha2(F.array_join(F.col("kids.digest"), ""), 256).alias("digest"), "kids")


def _climb(nodes: DataFrame, most: int, fan: int) -> list[DataFrame]:
    levels = [nodes]
    while fan ** (len(levels) - 1) < most:
        levels.append(staged(_above(levels[-1], len(levels), fan), "nodes"))
    return levels


def _remaining(level: DataFrame, k: int, fan: int) -> DataFrame:
    """The nodes of level k that are the only ones of their tree there, and were not so below."""
    alone = F.col("size") <= fan ** k
    return level.where(alone & (F.col("size") > fan ** (k - 1)) if k else alone)


def build(found: DataFrame, fan: int = FAN) -> Manifest:
    """The manifest over ``found`` (see ``leaves``)."""
    levels = _climb(*_ranked(staged(found, "leaves"), ["tree"], ["key", "digest"]), fan)
    subroots = None
    for k, level in enumerate(levels):
        last = _remaining(level, k, fan).select("tree", "digest")
        subroots = last if subroots is None else subroots.unionByName(last)
    ranked, most = _ranked(staged(subroots.withColumnRenamed("tree", "of"), "subroots"), [], ["of"])
    return Manifest(levels, _climb(ranked.withColumn("tree", F.lit("")), most, fan), fan)


def _beside(lo: Column, hi: Column) -> Column:
    """Digests in the parent's interval that lie before and after [lo, hi)."""
    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter("p_kids", keep), lambda x: x["digest"]), "")

    return F.struct(side(lambda x: x["hi"] <= lo).alias("left"), side(lambda x: x["lo"] >= hi).alias("right"))


def _descend(levels: list[DataFrame], fan: int, tops: DataFrame, carried: list[str]) -> DataFrame:
    """Level 0 with ``way``, the siblings of each node up to the root, and the ``carried`` columns.

    ``tops`` has (tree, way, and the carried columns) of the node that remains of each tree.
    """
    said = tops.select(F.col("tree").alias("t_tree"), "way", *carried)
    above = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        here = _remaining(level, k, fan).join(said, F.col("tree") == F.col("t_tree")).drop("t_tree")
        if above is not None:
            wider = above.select(
                F.col("tree").alias("p_tree"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                F.expr(f"lo div {fan ** (k + 1)}").alias("p_bucket"), F.col("kids").alias("p_kids"),
                F.col("way").alias("p_way"), *carried)
            within = ((F.col("tree") == F.col("p_tree")) & (F.col("bucket") == F.col("p_bucket"))
                      & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
            below = (level.where(F.col("size") > fan ** k)
                     .withColumn("bucket", F.expr(f"lo div {fan ** (k + 1)}")).join(wider, within)
                     .withColumn("way", F.concat(F.array(_beside(F.col("lo"), F.col("hi"))), "p_way"))
                     .drop("bucket", "p_tree", "p_lo", "p_hi", "p_bucket", "p_kids", "p_way"))
            here = here.unionByName(below)
        above = here
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with ``subroot``, ``root`` and ``way``: (left, right) siblings' digests per level, bottom first."""
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    root = manifest.top[-1].select("tree", none.alias("way"), F.col("digest").alias("root"))
    subroots = _descend(manifest.top, manifest.fan, root, ["root"]).select(
        F.col("of").alias("tree"), "way", "root", F.col("digest").alias("subroot"))
    return _descend(manifest.levels, manifest.fan, staged(subroots, "subroots"), ["root", "subroot"])


def fold(leaf: str, way: str = "way") -> Column:
    """The root that a leaf digest leads to with the siblings of ``way``."""
    return F.aggregate(way, F.col(leaf), lambda at, x: F.sha2(F.concat(x["left"], at, x["right"]), 256))


def proof_digest(way: str = "way") -> Column:
    """Digest of all siblings of ``way``, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(way, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame, claimed: Column, fields: tuple[str, ...] = FIELDS, group: str = "lang",
          key: str = "doc_id", fan: int = FAN) -> DataFrame:
    """Which rows still lead to the root when ``claimed`` is the digest that someone holds of them.

    One row per row of ``docs``: key, leaf, subroot, root, proof_sha256 (all of
    ``docs`` itself), folded_root (from the claimed digest), verified.
    """
    found = leaves(docs, digest(*[F.col(f) for f in fields]), group, key, claim=claimed)
    proven = proofs(build(found, fan)).withColumn("folded_root", fold("claim"))
    return proven.select("key", F.col("digest").alias("leaf"), "subroot", "root",
                         proof_digest().alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
