"""Mixing sources to target weights, by exact quotas of permuted blocks.

1. Sources, by code point (null last), weigh ``WEIGHTS`` in turn and share
   ``SHARE`` of all words. No target exceeds ``MOST`` times its source's size:
   the excess is shared again by weight until none is above. In closed form
   this is one water level, found by running sums over the sources.
2. Documents of a source are permuted by dealing them, by a hash, into blocks
   of about ``BLOCK_WORDS`` words, and ordering the blocks by a hash. A target
   of one source size or more takes every block that often, whole; the rest is
   an exact quota of blocks from the start of the permutation, of which the
   last gives its first documents up to the target.
3. The quotas are dealt to output shards by a splitting tree: each node halves
   its blocks, and how many of each source go left is drawn from the
   multivariate hypergeometric distribution, source after source. A shard's
   quota of a source is a range of that source's permutation, so shards are
   disjoint and together whole.
4. Each shard is shuffled by itself.

All draws are hashes of a seed, so reruns agree. Only DataFrame functions are
used. Sources are few beside rows: their table has one row each, and a tree
node one number per source.

A null text has size 0; rows that repeat an id are documents of their own;
rows that agree in id and text take the same draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillkit.llm.common import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 1 << 16
SHARD_BLOCKS = 64
SEED = 20240229
WORD = "[^\\x20\\x09-\\x0D]+"


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, share: float = SHARE, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with place (0, 1, ..), weight and target."""
    ranked = (sizes.withColumn("place", F.row_number().over(
        Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
        .withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]),
                                    F.col("place") % len(weights)))
        .withColumn("cap", F.col("source_size") * most))
    # sources reach their cap in the order of cap / weight
    upto = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.partitionBy()
    level = (share * F.sum("source_size").over(all_rows) - (F.sum("cap").over(upto) - F.col("cap"))) / (
        F.sum("weight").over(all_rows) - (F.sum("weight").over(upto) - F.col("weight")))
    # the level that is right is that of the first source it does not cap
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(
        F.col("cap") / F.col("weight"), "place", "level"))).over(all_rows)
    return (ranked.withColumn("level", level)
            .withColumn("water", first["level"])
            .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))))
            .select("source", "source_size", "place", "weight", "target"))


def _hypergeometric(n: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` of ``n`` are among ``good`` (all long), from a uniform number.

    Outcomes are weighed from the mode up and down by the ratio of
    neighbours, 12 deviations to either side, beyond which weights vanish.
    """
    lo, hi = F.greatest(F.lit(0).cast("long"), draws + good - n), F.least(draws, good)
    mode = F.greatest(lo, F.least(hi, F.floor((draws + 1) * (good + 1) / (n + 2)).cast("long")))
    p = good / n
    reach = F.ceil(12 * F.sqrt(draws * p * (1 - p)) + 12).cast("long")
    none = F.array().cast("array<bigint>")

    def up_ratio(x: Column) -> Column:
        return ((good - x) * (draws - x)).cast("double") / ((x + 1) * (n - good - draws + x + 1))

    def walk(m: Column) -> Column:
        ups = F.when(m < F.least(hi, m + reach), F.sequence(m, F.least(hi, m + reach) - 1)).otherwise(none)
        downs = F.when(m > F.greatest(lo, m - reach),
                       F.sequence(m - 1, F.greatest(lo, m - reach), F.lit(-1).cast("long"))).otherwise(none)
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        total = lambda steps, ratio: F.aggregate(
            steps, start, lambda a, x: _let(a["w"] * ratio(x), lambda w: F.struct(
                w.alias("w"), (a["sum"] + w).alias("sum"))), lambda a: a["sum"])
        down_ratio = lambda x: 1 / up_ratio(x)

        def choose(goal: Column) -> Column:
            def pick(steps, ratio, begin, shift):
                return F.aggregate(steps, begin, lambda a, x: _let(a["w"] * ratio(x), lambda w: F.struct(
                    w.alias("w"), (a["sum"] + w).alias("sum"),
                    F.when((a["got"] < 0) & (a["sum"] + w >= goal), x + shift).otherwise(a["got"]).alias("got"))))

            begin = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"),
                             F.when(goal <= 1.0, m).otherwise(F.lit(-1).cast("long")).alias("got"))
            return _let(pick(ups, up_ratio, begin, 1), lambda a: _let(
                pick(downs, down_ratio, F.struct(F.lit(1.0).alias("w"), a["sum"].alias("sum"),
                                                 a["got"].alias("got")), 0),
                lambda b: F.when(b["got"] < 0, m).otherwise(b["got"])))

        return _let(u * (1.0 + total(ups, up_ratio) + total(downs, down_ratio)), choose)

    return F.when(n <= 0, F.lit(0).cast("long")).when(lo == hi, lo).otherwise(_let(mode, walk))


def split(node: Column, key: Column) -> Column:
    """Quotas that go to the left child: a multivariate hypergeometric draw of half."""
    total = F.aggregate(node, F.lit(0).cast("long"), lambda s, x: s + x)
    state = F.struct(total.alias("n"), F.floor(total / 2).cast("long").alias("draws"),
                     F.array().cast("array<bigint>").alias("out"))

    def draw(s: Column, good: Column) -> Column:
        got = _hypergeometric(s["n"], good, s["draws"], _uniform(key, F.size(s["out"])))
        return _let(got, lambda g: F.struct((s["n"] - good).alias("n"), (s["draws"] - g).alias("draws"),
                                            F.concat(s["out"], F.array(g)).alias("out")))

    return F.aggregate(node, state, draw, lambda s: s["out"])


#: Levels of the tree that a task goes down before its nodes are dealt to others.
DEEP = 6


def tree(quotas: DataFrame, levels: int) -> DataFrame:
    """(shard, place, quota) from one row of ``quotas`` (array, by place).

    Every ``DEEP`` levels the nodes are dealt out anew, so that the lower levels
    are drawn by many tasks.
    """
    nodes = quotas.select(F.lit(0).alias("shard"), F.col("quotas").alias("node"))
    for level in range(levels):
        halves = nodes.select("shard", "node", split(F.col("node"), F.struct(F.lit(level), F.col("shard"))).alias("left"))
        nodes = halves.select(F.posexplode(F.array(
            F.col("left"), F.zip_with("node", "left", lambda a, b: a - b))).alias("side", "node"), "shard").select(
            (F.col("shard") * 2 + F.col("side")).alias("shard"), "node")
        if level % DEEP == DEEP - 1 and level + 1 < levels:
            nodes = nodes.repartition("shard")
    return nodes.select("shard", F.posexplode("node").alias("place", "quota"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        share: float = SHARE, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """What the mix takes of every document.

    doc_id, source, t1, t2 (hashes of the text), size, source_size, target,
    taken (words, repeats counted) and shards: the output shard of each copy.
    """
    sized = staged(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.lit(7), F.col(text), F.lit(11)).alias("t2"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = (targets(per_source, share)
             .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                         .otherwise(0).cast("long"))
             .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
             .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")))
    goals = staged(goals, "targets")
    key = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("t1"), F.col("t2"))
    dealt = (sized.join(goals.withColumnRenamed("source", "source_"),
                        F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
             .withColumn("key", key)
             .withColumn("block", F.pmod(F.xxhash64(F.lit(SEED + 1), "key"), F.col("blocks"))))

    # permuted blocks, and the words of the source before each
    order = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(SEED + 2), "place", "block"), "block")
    blocks = (dealt.groupBy("place", "block", "whole", "rest").agg(F.sum("size").alias("words"))
              .withColumn("rank", F.row_number().over(order) - 1)
              .withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
                          - F.col("words"))
              .withColumn("room", F.col("rest") - F.col("before")))
    copies = F.col("whole") + F.when(F.col("room") > 0, 1).otherwise(0)
    blocks = staged(blocks.withColumn("copies", copies), "blocks")

    # quotas of (block, copy) pairs, dealt over the shards by the tree
    items = (blocks.where("copies > 0").select("place", "block", "rank", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
        .withColumn("item", F.row_number().over(Window.partitionBy("place").orderBy("copy", "rank")) - 1))
    count = items.groupBy("place").agg(F.count(F.lit(1)).alias("quota"))
    places = goals.select("place").join(count, "place", "left").select(
        "place", F.coalesce("quota", F.lit(0)).cast("long").alias("quota"))
    quotas = places.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "quota"))),
                                    lambda x: x["quota"]).alias("quotas"))
    total = places.agg(F.sum("quota")).first()[0] or 0
    levels = max(0, (-(-total // shard_blocks) - 1).bit_length())
    ranges = (tree(quotas, levels).withColumn("end", F.sum("quota").over(
        Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)))
        .where("quota > 0").select("place", "shard", F.explode(
            F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("item")))
    homes = (items.join(ranges, ["place", "item"]).groupBy("place", "block")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("copy", "shard"))),
                              lambda x: x["shard"]).alias("homes")))
    placed = blocks.select("place", "block", "room", "words").join(homes, ["place", "block"], "left")

    # the block that the quota ends in gives its first documents
    joined = dealt.join(placed, ["place", "block"])
    # (in the order of their keys, then the one nearest to what is missing)
    own = Window.partitionBy("place", "block")
    upto = own.orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    partial = (F.col("room") > 0) & (F.col("room") < F.col("words"))
    ended = (joined.where(partial).withColumn("fits", F.sum("size").over(upto) <= F.col("room"))
             .withColumn("gap", F.col("room") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))).over(own), F.lit(0)))
             .withColumn("off", F.when(~F.col("fits"), F.abs(F.col("size") - F.col("gap"))))
             .withColumn("nearest", F.rank().over(own.orderBy(F.asc_nulls_last("off"), "key")) == 1)
             .withColumn("extra", F.when(F.col("fits") | (F.col("nearest") & (F.col("off") < F.col("gap"))), 1)
                         .otherwise(0).cast("long"))
             .drop("fits", "gap", "off", "nearest"))
    others = joined.where(F.coalesce(~partial, F.lit(True))).withColumn("extra", F.when(F.col("room") > 0, 1).otherwise(0).cast("long"))
    return ended.unionByName(others).withColumn("copies", F.col("whole") + F.col("extra")).select(
        "doc_id", "source", "t1", "t2", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.when(F.col("copies") > 0, F.slice("homes", F.lit(1), F.col("copies").cast("int")))
        .otherwise(F.array().cast("array<int>")).alias("shards"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    share: float = SHARE) -> DataFrame:
    """The mix itself: the rows of ``docs``, as often as taken, shard by shard.

    Columns are those of ``docs``. Rows are partitioned by shard and shuffled
    in it.
    """
    names = {c: f"c{i}__{c}" for i, c in enumerate(docs.columns)}
    plan = mix(docs, doc_id, text, source, share).where(F.size("shards") > 0)
    taken = plan.groupBy("doc_id", "source", "t1", "t2").agg(F.first("shards").alias("shards"))
    rows = docs.withColumnsRenamed(names).withColumns({
        "t1": F.xxhash64(F.col(names[text])), "t2": F.xxhash64(F.lit(7), F.col(names[text]), F.lit(11))})
    # the texts need no sort for this join: the plan's rows are hashed instead
    joined = rows.join(taken.withColumnsRenamed({"t1": "p1", "t2": "p2"}).hint("shuffle_hash"),
                       (F.col("t1") == F.col("p1")) & (F.col("t2") == F.col("p2"))
                       & F.col(names[doc_id]).eqNullSafe(F.col("doc_id"))
                       & F.col(names[source]).eqNullSafe(F.col("source")))
    copies = joined.select(*names.values(), "t1", "t2", F.posexplode("shards").alias("copy", "shard"))
    shuffled = (copies.withColumn("at", F.xxhash64(F.lit(SEED + 3), "t1", "t2", F.col(names[doc_id]), "copy"))
                .repartition("shard").sortWithinPartitions("shard", "at"))
    return shuffled.select(*names.values()).withColumnsRenamed({v: k for k, v in names.items()})
