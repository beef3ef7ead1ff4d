"""Suffix-array dedup: find and remove byte strings that repeat in a corpus.

Every byte covered by a string of ``length`` bytes that also starts elsewhere
(same text included) is removed, judged on the input.

1. Each text is cut by content anchors (``anchors.owned_runs``): each string
   of ``length`` bytes is owned by one anchor, and equal strings by equal
   anchors. One row per anchor is shuffled by its hash; an anchor hash that
   occurs once owns no repeat.
2. A segment (all strings of one anchor) that occurs twice as a whole is
   removed as a whole, by its hash. Where segments of one anchor differ, their
   bytes are fetched and sorted by a suffix array (``suffix_array``, linear
   grouping). Bytes over which no two segments of the anchor part from each
   other are one symbol there, so the array is short; the common prefixes of
   neighbours, in bytes, say which strings occur twice.
3. Anchors with more differing segments than ``most`` are split by the hash of
   each string of ``length`` bytes, counted with partial aggregation.

Everything is keyed by anchor or by the hash of a text, so no task holds more
than one anchor's segments (at most ``most``) or one text. Equal segments are
collapsed in each block before they are shuffled (``anchor_rows``), so a hot
anchor is a few rows per block. Texts are cut once: the anchors, and the bytes
that are fetched for them, are written to the shared folder.

Null and empty texts have nothing to remove. Rows that repeat a text are
copies: all of them lose what the text repeats.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillkit.llm.anchors import owned_runs
from tillkit.llm.common import (U64, Powers, blocks, flat_utf8, free_names, mix, prefix_hash, release,
                                ship, staged, text_key)
from tillkit.llm.suffix_array import common_prefixes, suffix_array

#: Bytes of a string that counts as repeated.
LENGTH = 200
#: Bytes of text handled at a time in a task.
BLOCK = 1 << 20
#: Differing segments of one anchor that one suffix array takes.
MOST = 8192
#: Symbols after which a suffix array is closed and a new one begun.
ARRAY = 1 << 15

ANCHORS = "h long, seg long, t1 long, t2 long, place long, many boolean, near boolean"


def _pack(first, width, lead):
    """Start, strings beyond the first (15 bits) and anchor distance (15) in one long."""
    return (first << 30) | (width << 15) | lead


def _unpack(place):
    return place >> 30, (place >> 15) & 32767, place & 32767


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """Anchors of each text (columns t1, t2, text), block by block, in one pass.

    A segment that occurs twice in one block is repeated, whatever other blocks
    hold: each of its places is a row with ``near``. The other rows are one per
    different segment of a block, ``many`` if it stands for several. So a line
    that every text repeats is one row per block where rows meet by anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = Powers()
        names = [c.split()[0] for c in ANCHORS.split(", ")]
        for batch in batches:
            text = batch.column("text").to_pylist()
            t1, t2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2"))
            for part in blocks(np.array([len(t) for t in text]), BLOCK):
                data, at = flat_utf8(text[part])
                got = owned_runs(data, at, length, pw)
                if not len(got["h"]):
                    continue
                order = np.lexsort((got["seg"], got["h"]))
                h, seg = got["h"][order], got["seg"][order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])))
                count = np.diff(np.append(first, len(order)))
                for near, take, many in ((False, first, count > 1), (True, np.flatnonzero(np.repeat(count > 1, count)), None)):
                    own = order[take]
                    place = _pack(got["first"][own], (got["last"] - got["first"])[own], got["lead"][own])
                    doc = got["doc"][own]
                    flags = [np.ones(len(own), bool) if many is None else many, np.full(len(own), near)]
                    cols = [h[take], seg[take], t1[part][doc], t2[part][doc], place, *flags]
                    for i in range(0, len(own), 65536):
                        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 65536]) for c in cols], names)
        del pw
        release()

    return texts.mapInArrow(run, ANCHORS)


# --- the strings of one anchor's segments ---------------------------------

def _agree(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _parts(side: list[bytes]) -> list[int]:
    """Distances from the anchor at which any two of the strings part."""
    ordered = sorted(set(side))
    return sorted({_agree(a, b) for a, b in itertools.pairwise(ordered)})


class Sorter:
    """Collects segments of several anchors and sorts them in one suffix array."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.clear()

    def clear(self) -> None:
        self.text: list[int] = []     # symbols
        self.weight: list[int] = []   # bytes of each symbol
        self.owner: list[tuple] = []  # (key, first byte of the symbol) or None at an end mark
        self.names: dict = {}

    def add(self, segments: list[tuple]) -> None:
        """Segments (key, lead, bytes, open) of one anchor, all different."""
        lefts = [b[:lead][::-1] for _, lead, b, _ in segments]
        rights = [b[lead:] for _, lead, b, _ in segments]
        left_cuts, right_cuts = _parts(lefts), _parts(rights)
        group = len(self.text)
        for key, lead, b, is_open in segments:
            n = len(b)
            cuts = [lead - c for c in reversed(left_cuts) if c < lead]
            cuts += [lead + c for c in right_cuts if 0 < c and lead + c < n]
            bounds = [0, *cuts, n]
            for lo, hi in itertools.pairwise(bounds):
                # equal bytes at one distance from one anchor are one symbol
                name = (group, lo - lead, b[lo:hi])
                self.text.append(self.names.setdefault(name, len(self.names) + 1))
                self.weight.append(hi - lo)
                self.owner.append((key, lo, n) if is_open else None)
            self.names[(group, key, None)] = mark = len(self.names) + 1
            self.text.append(mark)  # no suffix reads past its segment
            self.weight.append(0)
            self.owner.append(None)

    def spans(self) -> Iterator[tuple]:
        """(key, from, to) of the bytes that strings occurring twice cover."""
        text, length = self.text, self.length
        order = suffix_array(text)
        same = common_prefixes(text, order)
        reach = np.concatenate([[0], np.cumsum(self.weight)])
        best = np.zeros(len(text), dtype=np.int64)
        at = np.array(order, dtype=np.int64)
        shared = np.array(same, dtype=np.int64)
        best[at] = reach[at + shared] - reach[at]
        before = at[:-1]
        best[before] = np.maximum(best[before], reach[before + shared[1:]] - reach[before])
        for i in np.flatnonzero(best >= length):
            if (own := self.owner[i]) is None:
                continue
            key, lo, n = own
            last = min(lo + self.weight[i] - 1, lo + int(best[i]) - length, n - length)
            if last >= lo:
                yield key, lo, last + length
        self.clear()


def _bodies(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted segments; ``texts`` has t1, t2, text and may have more."""
    per_text = wanted.groupBy("t1", "t2").agg(
        F.collect_list(F.struct("h", "place", "open", "d")).alias("_wanted"))
    names = ["h", "t1", "t2", "place", "open", "d", "body"]
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            t1, t2 = batch.column("t1").to_pylist(), batch.column("t2").to_pylist()
            for i, key in enumerate(zip(t1, t2)):
                if key == last:
                    continue  # a copy: the same segments again
                last = key
                body = batch.column("text")[i].as_py().encode("utf-8", "surrogatepass")
                out = []
                for w in batch.column("_wanted")[i].as_py():
                    first, width, _ = _unpack(w["place"])
                    out.append((w["h"], *key, w["place"], w["open"], w["d"],
                                body[first:first + width + length]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return texts.join(per_text, ["t1", "t2"]).mapInArrow(
        run, "h long, t1 long, t2 long, place long, open boolean, d long, body binary")


def _sorted_spans(bodies: DataFrame, length: int) -> DataFrame:
    """Spans (t1, t2, span) of the open segments, by suffix arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sorter = Sorter(length)

        def rows(found):
            out = []
            for (t1, t2, first), lo, hi in found:
                out.append((t1, t2, ((first + lo) << 24) | (hi - lo)))
            return pd.DataFrame(out, columns=["t1", "t2", "span"])

        def flush(group):
            distinct = {}
            for t1, t2, place, is_open, body in group:
                first, _, lead = _unpack(place)
                distinct.setdefault(body, ((t1, t2, first), lead, body, is_open))
            if len(distinct) > 1:
                sorter.add(list(distinct.values()))

        now, group = None, []
        for pdf in frames:
            for h, t1, t2, place, is_open, body in zip(
                    pdf.h.tolist(), pdf.t1.tolist(), pdf.t2.tolist(), pdf.place.tolist(),
                    pdf.open.tolist(), pdf.body.tolist()):
                if h != now:
                    flush(group)
                    now, group = h, []
                    if len(sorter.text) >= ARRAY:
                        yield rows(sorter.spans())
                group.append((t1, t2, place, is_open, body))
        flush(group)
        if sorter.text:
            yield rows(sorter.spans())

    return (bodies.repartition("h").sortWithinPartitions("h")
            .select("h", "t1", "t2", "place", "open", "body")
            .mapInPandas(run, "t1 long, t2 long, span long"))


def _hashed_spans(bodies: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many segments: strings meet by their hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pw = Powers()
        for pdf in frames:
            for h, t1, t2, place, is_open, body in zip(
                    pdf.h.tolist(), pdf.t1.tolist(), pdf.t2.tolist(), pdf.place.tolist(),
                    pdf.open.tolist(), pdf.body.tolist()):
                first, width, _ = _unpack(place)
                data = np.frombuffer(body, dtype=np.uint8)
                up, down = pw.upto(len(data) + 1)
                sums = prefix_hash(data.astype(U64) + U64(1), up)
                lo = np.arange(width + 1)
                yield pd.DataFrame({
                    "h": h, "w": mix(span_hash_of(sums, down, lo, length)).view(np.int64),
                    "t1": t1, "t2": t2, "open": is_open, "start": first + lo})

    strings = bodies.select("h", "t1", "t2", "place", "open", "body").mapInPandas(
        run, "h long, w long, t1 long, t2 long, open boolean, start long").dropDuplicates(
        ["h", "w", "t1", "t2", "start"])
    twice = strings.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "w")
    return (strings.where("open").join(twice, ["h", "w"])
            .select("t1", "t2", (F.shiftleft("start", 24) + F.lit(length)).alias("span")))


def span_hash_of(sums: np.ndarray, down: np.ndarray, lo: np.ndarray, length: int) -> np.ndarray:
    return (sums[lo + length] - sums[lo]) * down[lo]


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH,
                   most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Spans of repeated bytes of each different text.

    Returns (texts, spans): ``docs`` with two key columns t1 and t2 (the hash
    of the text), and one row per key with ``spans``, packed (start << 24 |
    bytes), of at least one span. ``docs`` must not have columns t1 and t2.
    """
    ship(docs.sparkSession)
    texts = docs.select("*", *text_key(text))
    long_enough = texts.where(F.octet_length(text) >= length)
    rows = staged(anchor_rows(long_enough.select("t1", "t2", F.col(text).alias("text")), length), "anchors")
    start = F.shiftright("place", 30)
    width = F.shiftright("place", 15).bitwiseAND(F.lit(32767))
    span = (F.shiftleft(start, 24) + width + F.lit(length)).alias("span")

    # rows of anchors that occur twice; all counts are partial sums, so a hot anchor is not one task's rows
    times = F.when(F.col("many"), 2).otherwise(1)
    anchors = rows.where(~F.col("near")).drop("near")
    often = anchors.groupBy("h").agg(F.sum(times).alias("n")).where("n > 1").select("h")
    shared = staged(anchors.join(often, "h"), "shared")
    segments = staged(shared.groupBy("h", "seg").agg(
        F.sum(times).alias("c"), F.min(F.struct("t1", "t2", "place")).alias("at")), "segments")
    whole = (shared.join(segments.where("c > 1").select("h", "seg"), ["h", "seg"]).select("t1", "t2", span)
             .unionByName(rows.where("near").select("t1", "t2", span)))
    differing = segments.groupBy("h").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    wanted = segments.join(differing, "h").select(
        "h", "at.t1", "at.t2", "at.place", (F.col("c") == 1).alias("open"), "d")
    sources = texts.withColumnRenamed(text, "text") if text != "text" else texts
    bodies = staged(_bodies(sources.select("t1", "t2", "text"), wanted, length), "bodies")
    spans = (whole.unionByName(_sorted_spans(bodies.where(F.col("d") <= most), length))
             .unionByName(_hashed_spans(bodies.where(F.col("d") > most), length)))
    return texts, spans.groupBy("t1", "t2").agg(F.collect_list("span").alias("spans"))


def merge(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the unions of packed spans, in order."""
    spans = np.sort(spans)
    lo, hi = spans >> 24, (spans >> 24) + (spans & 0xFFFFFF)
    top = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > top[:-1]])
    first = np.flatnonzero(new)
    return lo[first], top[np.concatenate([first[1:], [len(lo)]]) - 1]


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH,
                   most: int = MOST, as_text: bool = False) -> DataFrame:
    """``docs`` with what is left of each text.

    Adds ``kept`` (the remaining bytes; with ``as_text`` the characters that
    are whole, null for a null text), ``n_bytes``, ``n_removed`` and
    ``n_spans`` (maximal removed runs); a clashing column of ``docs`` keeps its
    name and the new one is prefixed with ``_``. Null texts count as empty.
    """
    inner = [c for c in docs.columns if c.lower() in ("t1", "t2", "spans", "_wanted")]
    back = {c: f"c{i}__{c}" for i, c in enumerate(inner)}
    safe = docs.withColumnsRenamed(back)
    texts, spans = repeated_spans(safe, back.get(text, text), length, most)
    key = back.get(text, text)
    joined = texts.join(spans, ["t1", "t2"], "left").drop("t1", "t2")
    kept, n_bytes, n_removed, n_spans = names = free_names(docs, "kept", "n_bytes", "n_removed", "n_spans")
    schema = T.StructType([f for f in safe.schema.fields] + [
        T.StructField(kept, T.StringType() if as_text else T.BinaryType()), T.StructField(n_bytes, T.LongType()),
        T.StructField(n_removed, T.LongType()), T.StructField(n_spans, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.schema.get_field_index("spans"))
            out = []
            for i, t in enumerate(batch.column(batch.schema.get_field_index(key)).to_pylist()):
                body = b"" if t is None else t.encode("utf-8", "surrogatepass")
                if not found[i].is_valid:
                    out.append((body, len(body), 0, 0))
                    continue
                lo, hi = merge(found[i].values.to_numpy(zero_copy_only=False).astype(np.int64))
                edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(body)]
                left = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((left, len(body), len(body) - len(left), len(lo)))
            cols = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "spans"]
            new = list(zip(*out)) or [[]] * 4
            left = pa.array(new[0], pa.binary())
            if as_text:
                nulls = batch.column(batch.schema.get_field_index(key)).is_null().to_pylist()
                left = pa.array([None if n else b.decode("utf-8", "ignore") for n, b in zip(nulls, new[0])], pa.string())
            yield pa.RecordBatch.from_arrays(
                cols + [left] + [pa.array(c, pa.int64()) for c in new[1:]],
                [n for n in batch.schema.names if n != "spans"] + names)

    return joined.mapInArrow(run, schema).withColumnsRenamed({v: k for k, v in back.items()})


def sha256(column: str) -> Column:
    """Lowercase hex digest of a binary column."""
    return F.sha2(F.col(column), 256)
