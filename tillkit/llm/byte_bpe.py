"""Byte-level BPE encoding and decoding.

A word is an array of one-byte pieces, and a fold merges the neighbours of
least rank until no neighbours have a rank. Two forms share this:

* ``encode_words`` is the native one, by Spark's higher-order functions, for
  tables of words. Ranks are a literal: ``RANK_BINS`` small maps, found by the
  CRC of the piece, as Spark searches a map from its start. Bytes travel as
  the Latin-1 characters of the same number, so that pieces are strings.
* ``encode`` is for texts. A block of texts is split to words (``pretoken``),
  and the merges are folded over all its distinct words at once, in arrays, in
  the task that reads the block; nothing is shuffled. (The native fold takes
  some 130 microseconds a word, too long for a corpus; see the README.)

A text's ids are its words' ids in order; decoding concatenates the pieces'
bytes. Null texts count as empty.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillkit.llm.common import Powers, blocks, free_names, release, ship
from tillkit.llm.words import split_words

#: Characters of text whose distinct words are encoded together.
BLOCK = 3 << 18
#: Words whose ids a task remembers from one block to the next.
REMEMBERED = 1 << 17
RANK_BINS = 1 << 15
NO_RANK = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal array of maps."""
    bins: list[dict[str, int]] = [{} for _ in range(RANK_BINS)]
    for piece, rank in ranks.items():
        name = piece.decode("latin-1")
        bins[zlib.crc32(name.encode("utf-8")) % RANK_BINS][name] = rank
    return F.from_json(F.lit(json.dumps(bins, separators=(",", ":"))), "array<map<string,int>>")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rank(bins: Column, piece: Column) -> Column:
    at = F.get(bins, (F.crc32(piece.cast("binary")) % RANK_BINS).cast("int"))
    return F.coalesce(F.try_element_at(at, piece), F.lit(NO_RANK))


def _merge(bins: Column, state: Column) -> Column:
    """The state (pieces p, ranks r of neighbours) after its least-ranked merge."""
    p, r = state["p"], state["r"]

    def merged(k: Column) -> Column:
        joined = F.concat(F.get(p, k - 1), F.get(p, k))

        def around(m: Column) -> Column:
            none = F.array().cast("array<int>")
            left = F.when(k > 1, F.array(_rank(bins, F.concat(F.get(p, k - 2), m)))).otherwise(none)
            right = F.when(k + 1 < F.size(p), F.array(_rank(bins, F.concat(m, F.get(p, k + 1))))).otherwise(none)
            n = F.size(p)
            return F.struct(
                F.concat(F.slice(p, F.lit(1), k - 1), F.array(m), F.slice(p, k + 2, n)).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), left, right,
                         F.slice(r, k + 2, n)).alias("r"))

        return _let(joined, around)

    def step(least: Column) -> Column:
        return F.when(least < NO_RANK, _let(F.array_position(r, least).cast("int"), merged)).otherwise(state)

    return _let(F.coalesce(F.array_min(r), F.lit(NO_RANK)), step)


def encode_word(bins: Column, word: Column) -> Column:
    """Ids of one word (a string of byte characters), as array<int>."""

    def fold(n: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))

        def start(p: Column) -> Column:
            ranks = F.transform(F.sequence(F.lit(1), n - 1),
                                lambda i: _rank(bins, F.concat(F.get(p, i - 1), F.get(p, i))))
            return F.aggregate(F.sequence(F.lit(1), n - 1),
                               F.struct(p.alias("p"), ranks.alias("r")),
                               lambda s, _: _merge(bins, s), lambda s: s["p"])

        return F.transform(_let(pieces, start), lambda q: _rank(bins, q))

    whole = lambda r: F.when(r < NO_RANK, F.array(r)).otherwise(_let(F.length(word), fold))
    return _let(_rank(bins, word), whole)


def encode_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of each word of an array, as array<array<int>>."""
    return _let(rank_literal(ranks), lambda bins: F.transform(words, lambda w: encode_word(bins, w)))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+sizes[0]-1, starts[1] .. and so on."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class Merger:
    """Encodes many words at once by folding ranked merges over their pieces."""

    #: Words of more bytes are merged by a heap, one at a time.
    LONG = 64

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of pieces side by side."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK)

    def _long(self, word: bytes) -> list[int]:
        """One word, least rank first and leftmost among equals, by a heap."""
        piece: list[bytes | None] = [word[i:i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        rank = self.ranks.get
        heap = [(r, i, 2) for i in range(len(word) - 1) if (r := rank(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if piece[i] is not None else len(word)
            if j >= len(word) or len(piece[i]) + len(piece[j]) != size:
                continue  # a side has changed
            piece[i], piece[j] = piece[i] + piece[j], None
            after[i] = after[j]
            if after[i] < len(word):
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < len(word):
                    joined = piece[a] + piece[after[a]]
                    if (r := rank(joined)) is not None:
                        heapq.heappush(heap, (r, a, len(joined)))
        return [self.ranks[p] for p in piece if p is not None]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        out: list = [None] * len(words)
        short = []
        for k, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[k] = (whole,)
            elif len(w) > self.LONG:
                out[k] = self._long(w)
            else:
                short.append(k)
        if short:
            sizes = np.array([len(words[k]) for k in short])
            piece = self.byte[np.frombuffer(b"".join(words[k] for k in short), dtype=np.uint8)]
            owner = np.repeat(np.array(short), sizes)
            while len(piece):
                same = np.append(owner[1:] == owner[:-1], False)
                rank = np.full(len(piece), NO_RANK, dtype=np.int64)
                at = np.flatnonzero(same)
                rank[at] = self._ranked(piece[at], piece[at + 1])
                while True:
                    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                    many = np.diff(np.append(start, len(piece)))
                    least = np.minimum.reduceat(rank, start)
                    done = least == NO_RANK
                    if done.sum() * 4 > len(done):
                        break  # a quarter has no merge left
                    hit = np.flatnonzero(rank == np.repeat(least, many))
                    hit = hit[rank[hit] < NO_RANK]
                    hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]  # leftmost of the word
                    piece[hit] = rank[hit]
                    keep = np.ones(len(piece), dtype=bool)
                    keep[hit + 1] = False
                    moved = np.cumsum(keep)[hit] - 1
                    piece, owner, rank = piece[keep], owner[keep], rank[keep]
                    for i in (moved, moved - 1):
                        i = i[(i >= 0) & (i + 1 < len(piece))]
                        joint = owner[i] == owner[i + 1]
                        rank[i[joint]] = self._ranked(piece[i[joint]], piece[i[joint] + 1])
                        rank[i[~joint]] = NO_RANK
                    rank[-1] = NO_RANK
                over = np.repeat(done, many)
                ended, edge = piece[over].tolist(), np.cumsum(many[done]).tolist()
                for k, lo, hi in zip(owner[start[done]].tolist(), [0, *edge], edge):
                    out[k] = ended[lo:hi]
                piece, owner = piece[~over], owner[~over]
        count = np.array([len(o) for o in out], dtype=np.int64)
        return np.fromiter(itertools.chain.from_iterable(out), dtype="<u4", count=int(count.sum())), count


class Pieces:
    """Decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pieces = {rank: piece for piece, rank in ranks.items()}
        every = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.sizes = np.array([len(p) for p in every])
        self.start = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(every), dtype=np.uint8)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of little-endian 32-bit ids, one piece after the other."""
        at = np.frombuffer(ids or b"", dtype="<u4")
        return self.data[_ragged(self.start[at], self.sizes[at])].tobytes()


def _run(docs: DataFrame, ranks: dict[bytes, int], text: str, back: bool) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    added = free_names(docs, "ids", "decoded")[:2 if back else 1]
    names = [*docs.columns, *added]
    sent = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, pw, pieces = Merger(sent.value), Powers(), Pieces(sent.value) if back else None
        known: dict[str, bytes] = {}

        def ids_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            new = [w for w in words if w not in known]
            flat, many = merger.encode([w.encode("utf-8", "surrogatepass") for w in new])
            edge = np.cumsum(many).tolist()
            fresh = {w: flat[a:b].tobytes() for w, a, b in zip(new, [0, *edge], edge)}
            every = [fresh.get(w) or known[w] for w in words]
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
            if len(fresh) <= REMEMBERED:
                known.update(fresh)
            return (np.frombuffer(b"".join(every), dtype="<u4"),
                    np.array([len(e) >> 2 for e in every], dtype=np.int64))

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            size = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
            for part in blocks(size, BLOCK):
                rows = part.stop - part.start
                found = split_words([t or "" for t in column.slice(part.start, rows).to_pylist()], pw)
                flat, many = ids_of(found.words)
                own = many[found.index]
                body = flat[_ragged((np.cumsum(many) - many)[found.index], own)].tobytes()
                per_row = np.bincount(found.text, weights=own, minlength=rows).astype(np.int64) * 4
                del found, flat, own
                at = np.concatenate([[0], np.cumsum(per_row)]).tolist()
                ids = [body[a:b] for a, b in zip(at, at[1:])]
                new = [pa.array(ids, pa.binary())]
                if back:
                    new.append(pa.array([pieces.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(c.slice(part.start, rows) for c in batch.columns), *new], names)
        release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, T.BinaryType()) for n in added]]))


def encode(docs: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: the text's token ids, little-endian unsigned 32-bit."""
    return _run(docs, ranks, text, back=False)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, the bytes that the ids turn back to.

    Both in one pass: one worker, one table of ranks and one block at a time.
    """
    return _run(docs, ranks, text, back=True)


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``: the bytes of its ids' pieces, one after the other."""
    spark = docs.sparkSession
    ship(spark)
    (name,) = free_names(docs, "decoded")
    sent = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            out = [pieces.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())],
                                             [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))
