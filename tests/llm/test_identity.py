"""Inputs on which equality by a weak hash, or a loose pattern, gave wrong results."""

import base64
import hashlib
import time

import public_tokenizers
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from tillkit.llm import byte_bpe, language_mix, license_scan, near_dup, quality_knn, token_counts
from tillkit.llm.common import Powers
from tillkit.llm.order_minhash import word_hashes
from tillkit.llm.words import split_words

import numpy as np

DOCS = "doc_id long, text string"


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


ONE = thue_morse(2048)
TWO = ONE.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_hash_stay_apart():
    found = split_words([f"{ONE} x {TWO}", TWO, ONE], Powers())
    assert [found.words[i].strip() for i in found.index] == [ONE, "x", TWO, TWO, ONE]


def test_token_counts_as_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rows = [(1, ONE[:1024]), (2, TWO[:1024]), (3, ONE), (4, TWO)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(rows, DOCS).coalesce(1), path).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_ids_as_the_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, ONE[:1024]), (2, TWO[:1024]), (3, ONE), (4, TWO)]
    out = byte_bpe.encode_and_decode(spark.createDataFrame(rows, DOCS).coalesce(1), ranks).collect()
    for r in out:
        text = dict(rows)[r.doc_id]
        assert list(np.frombuffer(r.ids, "<u4")) == lib.encode_ordinary(text) and bytes(r.decoded) == text.encode()


def test_near_dedup_keeps_both(spark):
    a, b = (np.frombuffer(w.encode(), np.uint8) for w in (ONE, TWO))
    assert word_hashes(a, Powers())[0] != word_hashes(b, Powers())[0]
    got = near_dup.near_duplicates(spark.createDataFrame([(1, ONE), (2, TWO), (3, ONE)], DOCS)).collect()
    assert {r.doc_id: r.group_id for r in got} == {1: 1, 2: 2, 3: 1}


def test_numbers_and_signs_are_no_letters(spark):
    rows = [(i, t, "de") for i, t in enumerate(["½ ½", "² Ⅷ", "123", "_ _", "ein haus", "é"])]
    got = {r.doc_id: r.lang_pred for r in language_mix.identify(spark.createDataFrame(rows, DOCS + ", lang string")).collect()}
    assert [got[i] for i in range(4)] == ["und"] * 4 and got[4] == got[5] == "de"


def test_tokenizers_that_begin_alike_are_told_apart(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        content = f.read()
    import json
    spec = json.loads(content)
    spec["model"]["merges"] = list(reversed(spec["model"]["merges"]))  # as long, other tokens
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    same = tmp_path / "same.json"
    same.write_text(json.dumps(json.loads(content)), encoding="utf-8")
    docs = spark.createDataFrame([(1, "international understanding")], DOCS)
    counts = [token_counts.count_tokens(docs, str(p)).first().n_tokens for p in (same, other, same)]
    assert counts[0] == counts[2] == len(tokenizers.Tokenizer.from_file(path).encode("international understanding").ids)


def test_a_megabyte_of_open_comments(spark):
    bad = ["/* " * 350_000, "<!-- " * 200_000, "/* <!-- " * 130_000, '""" ' * 100_001, "/*/ " * 250_000]
    files = spark.createDataFrame([(f"/a/{i}.c", t) for i, t in enumerate(bad)], "path string, text string").cache()
    files.count()
    t0 = time.time()
    blocks = files.select(license_scan._enclosed(F.col("text")).alias("b")).collect()
    assert time.time() - t0 < 30
    assert [len(r.b) for r in blocks][:3] == [0, 0, 0]


def test_comments_are_cut_as_before(spark):
    texts = ["/* a */ x /* b", "<!-- /* --> y */ z", '"""doc""" """open', "/*a*//*b*/", "<!--a--><!--b", "no marks", "*/ /* c */", "/* <!-- */ -->"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_extract_all("t", F.lit(license_scan.ENCLOSED), F.lit(0))
    for r in df.select(license_scan._enclosed(F.col("t")).alias("a"), plain.alias("b")).collect():
        assert r.a == r.b


def test_quality_model_does_not_depend_on_row_order(spark):
    rows = [(1, "good text of many words"), (1, "another text"), (2, "bad bad"), (3, "good words again"), (3, "zz")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    models = [quality_knn.learn(spark.createDataFrame(r, DOCS).repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert np.allclose(models[0]["latent"] @ models[0]["latent"].T, models[1]["latent"] @ models[1]["latent"].T)
    assert hashlib.sha256(models[0]["y"].tobytes()).digest() == hashlib.sha256(models[1]["y"].tobytes()).digest()
