import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillkit.llm import byte_bpe, token_counts
from tillkit.llm.common import Powers
from tillkit.llm.words import split_words

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def texts(n, seed=3):
    rng = random.Random(seed)
    signs = "  \n\t'''srtvlemdSLL12٣é漢ß!?-. 　\x00😀"
    some = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return some + [None, "", "a<|endoftext|>b", " <|endoftext|><|endoftext|> x", "x'", "x'r", "x'l", "'ll 're",
                   " " * 3000 + "a", "ab" * 3000, "the quick brown fox " * 2000, "zq" * 40 + " " + "x" * 65]


@pytest.fixture(scope="module")
def docs(frame):
    rows = list(enumerate(texts(400)))
    return frame(rows + rows[:3] + [(None, "null id")], "doc_id long, text string", {"n_tokens": "mine", "ids": 1})


def test_counts_equal_library(docs):
    library = Tokenizer.from_file(JSON)
    got = token_counts.count_tokens(docs, JSON, limit=20).collect()
    assert len(got) == docs.count()
    for r in got:
        want = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r["_n_tokens"], r.n_bytes, r.over_limit, r.n_tokens) == (
            want, len((r.text or "").encode()), want > 20, "mine")


def test_counts_survive_clearing_of_states():
    with open(JSON, encoding="utf-8") as f:
        counter = token_counts.Counter(f.read(), states=50)
    library = Tokenizer.from_file(JSON)
    some = ["Hello there, general transducers are compiled again and again", "unbelievable words", "漢字かな"] * 3
    assert counter.counts(some).tolist() == [len(library.encode(t).ids) for t in some]


def test_ids_equal_library_and_decode(docs):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS, ids="_ids").collect()
    assert len(got) == docs.count()
    for r in got:
        assert np.frombuffer(r["_ids"], "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")


def test_native_fold_equals_arrays(frame):
    words = split_words([t for t in texts(60) if t and len(t) < 50], Powers()).words
    flat, many = byte_bpe.Merger(RANKS).encode([w.encode() for w in words])
    table = frame([([w.encode().decode("latin-1") for w in words],)], "words array<string>")
    got = table.select(byte_bpe.encode_words(F.col("words"), RANKS).alias("c")).first().c
    assert [len(c) for c in got] == many.tolist()
    assert [i for c in got for i in c] == flat.tolist()


def test_empty_table(frame):
    none = frame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, JSON).collect() == []
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS), RANKS).collect() == []
