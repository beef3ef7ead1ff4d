"""Token counts of whole texts by a compiled tokenizer.

The tokenizer file (byte-level BPE with a merge list) is compiled to two
deterministic transducers. ``pretoken`` splits text into words: chunks are run
from all states at once and their state maps compose through a prefix scan.
``BpeMachine`` reads a word's bytes; a state holds the cuts at which a token may
still be under way, with the last token before each, and each transition is
annotated with the tokens that its byte adds to the encoding (fewer than
none where tokens merge). States are compiled when first reached
and at most ``STATES`` are held.

A text's count is the sum over its words; distinct words of a block run once.
Null counts as an empty text. A special token's string inside a text is one
token, as the library has it by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillkit.llm.common import Powers, blocks, free_names, ship
from tillkit.llm.words import split_words

#: Characters of text handled at a time in a task.
BLOCK = 2_500_000
#: States held at once; beyond, the machine is compiled anew from the next word on.
STATES = 400_000


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte.

    Printable Latin-1 stands for itself; the others, in order, for the letters
    from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in out]
    return out | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class BpeMachine:
    """Counts the BPE tokens of a word, byte by byte."""

    def __init__(self, token_of: dict[bytes, int], merges: list[tuple[bytes, bytes]],
                 states: int = STATES) -> None:
        self.states = states
        order = {bytes([b]): b - 256 for b in range(256)}  # single bytes come before all merges
        self.split: dict[bytes, tuple[bytes, bytes]] = {}
        for k, (a, b) in enumerate(merges):
            if a + b not in order:
                order[a + b] = k
                self.split[a + b] = (a, b)
        self.order = order
        self.merge = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.usable = {t for t in order if self._whole(t)}
        self.begun = {t[:i] for t in self.usable for i in range(1, len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all compiled states but the one before the first byte."""
        self.step: dict[int, int] = {}
        self.found: dict[tuple, int] = {}
        self.states_at: list[tuple] = []
        self._state((b"", ((0, None, 0),)))

    def _state(self, key: tuple) -> int:
        if (known := self.found.get(key)) is None:
            known = self.found[key] = len(self.states_at)
            self.states_at.append(key)
        return known

    def _whole(self, t: bytes) -> bool:
        """Whether the encoding of ``t`` is ``t`` alone."""
        if len(t) == 1:
            return True
        a, b = self.split[t]
        return self._stay(a, b, self.order[t])

    def _stay(self, a: bytes, b: bytes, before: float) -> bool:
        """Whether the halves of a cut keep apart until merge ``before``.

        Undoes the merges of both sides, latest first: the pair that met at
        the cut in between must have no earlier merge.
        """
        limit = before
        while True:
            met = self.merge.get((a, b))
            if met is not None and met < limit:
                return False
            left, right = self.order[a], self.order[b]
            if left < 0 and right < 0:
                return True
            # the left one's merge comes first among equals: it starts further left
            if left > right:
                limit, a = left, self.split[a][1]
            else:
                limit, b = right + 1, self.split[b][0]

    def _apart(self, a: bytes, b: bytes) -> bool:
        """Whether tokens ``a`` and ``b`` stay two tokens side by side."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.states:
                self.pairs.clear()
            known = self.pairs[(a, b)] = self._stay(a, b, float("inf"))
        return known

    def _compile(self, state: int, byte: int) -> int:
        """The transition from ``state`` by ``byte``: next state << 8 | (emitted + 128)."""
        tail, cuts = self.states_at[state]
        grown = tail + bytes([byte])
        end = len(grown)
        for back, last, behind in cuts:  # the longest token first
            token = grown[end - back - 1:]
            if token in self.usable and (last is None or self._apart(last, token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        emitted = behind + 1
        open_cuts = [(back + 1, last, behind - emitted) for back, last, behind in cuts
                     if grown[end - back - 1:] in self.begun]
        tail = grown[end - open_cuts[0][0]:] if open_cuts else b""
        target = self._state((tail, (*open_cuts, (0, token, 0))))
        out = self.step[state << 8 | byte] = target << 8 | (emitted + 128)
        return out

    def tokens(self, word: bytes) -> int:
        if len(self.states_at) > self.states:
            self.clear()
        step, state, total = self.step, 0, 0
        for b in word:
            move = step.get(state << 8 | b)
            if move is None:
                move = self._compile(state, b)
            state = move >> 8
            total += (move & 255) - 128
        return total


class Counter:
    """The whole tokenizer of a ``tokenizers`` JSON file."""

    def __init__(self, source: str, states: int = STATES) -> None:
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" \
                or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer is needed")
        byte_of = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(byte_of[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = {raw(t): k for t, k in model["vocab"].items() if t not in self.special}
        self.machine = BpeMachine(vocab, [(raw(a), raw(b)) for a, b in pairs], states)
        self.pw = Powers()
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word; the latest ``STATES`` or fewer words are remembered."""
        if (n := self.known.get(word)) is None:
            if len(self.known) >= self.machine.states:
                self.known.clear()
            n = self.known[word] = self.machine.tokens(word.encode("utf-8", "surrogatepass"))
        return n

    def counts(self, texts: list[str]) -> np.ndarray:
        pieces, owner, out = [], [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            parts = [text]
            for s in self.special:
                parts = [x for p in parts for x in p.split(s)]
            out[k] = len(parts) - 1
            pieces += parts
            owner += [k] * len(parts)
        found = split_words(pieces, self.pw)
        per_word = np.array([self.word(w) for w in found.words] or [0])
        if len(found.index):
            sums = np.bincount(found.text, weights=per_word[found.index], minlength=len(pieces))
            out += np.bincount(owner, weights=sums, minlength=len(texts)).astype(np.int64)
        return out


_MADE: dict = {}


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the path of the JSON file on the driver; its content
    travels to the tasks as a broadcast value. Clashing columns of ``docs``
    keep their names and the new ones are prefixed with ``_``.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    source, name = spark.sparkContext.broadcast(content), sha256(content.encode()).hexdigest()
    names = free_names(docs, "n_bytes", "n_tokens", "over_limit")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()),
                           T.StructField(names[1], T.LongType()), T.StructField(names[2], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _MADE.get("id") != name:
            _MADE["id"], _MADE["counter"] = name, Counter(source.value)
        counter = _MADE["counter"]
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
            count = np.zeros(len(texts), dtype=np.int64)
            for part in blocks(size, BLOCK):
                count[part] = counter.counts(texts[part])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(size), pa.array(count), pa.array(count > limit)],
                [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def token_totals(counted: DataFrame, by: str) -> DataFrame:
    """Documents and tokens of each value of a column."""
    return counted.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
