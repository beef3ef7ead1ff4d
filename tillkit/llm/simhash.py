"""SimHash near-duplicates by multi-index hashing.

The fingerprint of a text has 64 bits: bit i is set if it is set in more than
half of the XXH64 hashes (``SEED``) of the text's shingles of ``WORDS`` words,
each occurrence counted. Fingerprints link if at most ``MOST`` = 3 bits differ.

1. Fingerprints are cut into ``SEGMENTS`` = 2 halves: of two that differ in 3
   bits, one half differs in at most ``RADIUS`` = 1. The table of a segment
   holds the distinct values found there.
2. Each value enumerates its Hamming ball of that radius (33 values) and looks
   them up in the table, so meetings of values grow with their number, not with
   the square of a group of near copies.
3. The fingerprints of two values that met, in blocks of about ``CHUNK``, are
   compared over all 64 bits in one task. Of what links within two blocks, a
   spanning star of each connected part leaves the task: at most one row per
   fingerprint, and no link between different fingerprints is lost to the
   components. No bucket or number of partners is capped.
4. Stars give components by star rounds (``components.connected``).

Equal fingerprints are one node from the start, so exact copies, and texts
without words, are never paired.

Defined cases: a null or blank text has the fingerprint zero, linked like any
other; a text of fewer words than a shingle is one shingle; rows that repeat a
doc_id are rows of their own; a null doc_id names no component unless it is
alone in it; an empty table gives an empty result. Columns other than the id
and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillkit.llm.common import release, ship, staged
from tillkit.llm.components import connected

WORDS = 3
SEED = 42
MOST = 3
SEGMENTS, RADIUS = 2, 1
BITS = 64 // SEGMENTS
CHUNK = 1024
#: Bytes of a text whose words are held at a time.
PIECE = 1 << 20


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of ``data``, a piece of about ``PIECE`` bytes at a time."""
    start = 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and not data[end:end + 1].isspace():
            end += 1
        yield data[start:end].split()
        start = end


def _votes(shingles: list[bytes], seed: int) -> np.ndarray:
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    return np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text, as an unsigned number."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: only A-Z
    votes, n, last = np.zeros(64, np.int64), 0, []
    for piece in _pieces(data):
        held = last + piece
        shingles = [b" ".join(x) for x in zip(*(held[i:] for i in range(words)))]
        if shingles:
            votes += _votes(shingles, seed)
            n += len(shingles)
        last = held[max(len(held) - words + 1, 0):] if words > 1 else []
    if not n and last:
        votes, n = _votes([b" ".join(last)], seed), 1
    return int(np.packbits(2 * votes > n).view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                 seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])
        release()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def _table(fps: DataFrame) -> DataFrame:
    """(s, v, fp): the value v of each segment s of each fingerprint."""
    parts = [F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", BITS * s).bitwiseAND((1 << BITS) - 1).alias("v"))
             for s in range(SEGMENTS)]
    return fps.select(F.explode(F.array(*parts)).alias("x"), "fp").select("x.s", "x.v", "fp")


def _meetings(table: DataFrame, chunk: int) -> DataFrame:
    """(s, v, n, u, m): values v <= u in each other's ball that can hold a link, and their numbers of blocks."""
    values = staged(table.groupBy("s", "v").agg(F.count(F.lit(1)).alias("c"))
                    .withColumn("n", F.ceil(F.col("c") / chunk).cast("int")), "values")
    flips = [F.col("v").bitwiseXOR(F.lit(1 << b)) for b in range(BITS)]
    ball = values.select("s", "v", "n", F.explode(F.filter(F.array(*flips), lambda u: u > F.col("v"))).alias("u"))
    others = values.select("s", F.col("v").alias("u"), F.col("n").alias("m"))
    same = values.where("c > 1").select("s", "v", "n", F.col("v").alias("u"), F.col("n").alias("m"))
    return ball.join(others, ["s", "u"]).select("s", "v", "n", "u", "m").unionByName(same)


def _stars(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centre, other) of each connected part of the links between ``a`` and ``b``."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= most
    both = np.concatenate([a, b])
    label, none = np.arange(len(both)), len(both)
    while True:
        down = np.minimum(label[len(a):], np.where(near, label[:len(a), None], none).min(axis=0, initial=none))
        up = np.minimum(label[:len(a)], np.where(near, down[None, :], none).min(axis=1, initial=none))
        new = np.concatenate([up, down])
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(both)))
    return both[label[other]], both[other]


def links(fps: DataFrame, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """(a, b): stars that connect what links among the distinct fingerprints ``fp`` of ``fps``."""
    if most >= SEGMENTS * (RADIUS + 1):
        raise ValueError(f"{SEGMENTS} segments with balls of {RADIUS} find up to {SEGMENTS * (RADIUS + 1) - 1} bits")
    table = _table(fps)
    met = staged(_meetings(table, chunk), "meetings")
    used = (met.select("s", "v", "n").unionByName(met.select("s", F.col("u").alias("v"), F.col("m").alias("n"))).distinct())
    blocks = staged(table.join(used, ["s", "v"])
                    .groupBy("s", "v", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("i"))
                    .agg(F.collect_list("fp").alias("fps")), "blocks")
    dealt = (met.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
             .where((F.col("v") < F.col("u")) | (F.col("i") <= F.col("j"))))
    pairs = (dealt.join(blocks.withColumnRenamed("fps", "one"), ["s", "v", "i"])
             .join(blocks.select("s", F.col("v").alias("u"), F.col("i").alias("j"), F.col("fps").alias("two")),
                   ["s", "u", "j"]).select("one", "two"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_stars(one.values.to_numpy().view(np.uint64), two.values.to_numpy().view(np.uint64), most)
                     for one, two in zip(batch.column("one"), batch.column("two"))]
            ends = [np.concatenate([x[k] for x in found] + [np.empty(0, np.uint64)]).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST,
                   chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the least doc_id of the component)."""
    found = staged(fingerprints(docs, doc_id, text), "fingerprints")
    fps = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = connected(links(fps.select("fp"), most, chunk))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", "root")
    linked = staged(named.where("root is not null"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    single = fps.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    return found.join(linked.join(least, "root").select("fp", "component_id").unionByName(single), "fp").select(
        "doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    """16 lowercase hex digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
