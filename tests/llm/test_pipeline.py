"""The corpus pipeline: each stage of a run against a plain form of it, on the stage's own input."""

import base64
import hashlib
import os
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_near_dup import groups

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture_rows():
    rng = random.Random(11)
    vocab = {"en": ["the", "house", "river", "stone", "light", "water", "seven", "garden"],
             "de": ["das", "haus", "fluß", "stein", "licht", "wasser", "sieben", "gärten"]}
    passage = " ".join(rng.choice(vocab["en"]) + str(rng.randrange(99)) for _ in range(60))
    rows = []
    for i in range(40):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(vocab[lang]) + ("" if rng.random() < 0.6 else str(rng.randrange(1000))) for _ in range(rng.randint(30, 120))]
        text = " ".join(words)
        if i % 5 == 0:
            text += "\n" + passage + " ünd " + str(i)
        rows.append((i, text, lang if i % 7 else None, f"s{i % 3}" if i % 6 else None, len(text)))
        if i % 8 == 0:  # a near copy, and an exact one
            rows.append((100 + i, " ".join(words[:-1] + ["other"]) + text[len(" ".join(words)):], lang, "s1", 1))
            rows.append((200 + i, text, lang, "s2", None))
    rows += [(300, None, "en", "s0", None), (301, "", "en", "s0", 0), (302, "½ ½ 123", "en", "s1", 7), (303, "a", None, None, 1),
             (304, "b " * 900, "de", "s9", 1800), (305, rows[0][1], "en", "s0", 5), (305, rows[0][1], "en", "s0", 5), (None, "x y z", "de", "s1", 5)]
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The folder of the fixture, and the rows and columns after each stage."""
    root = str(tmp_path_factory.mktemp("pipeline"))
    extra = {"kept": 7, "lang_pred": "z", "shards": 1, "ids": 2, "group_id": 3}
    spark.createDataFrame(fixture_rows(), SCHEMA).withColumns({c: F.lit(v) for c, v in extra.items()}).coalesce(2).write.parquet(
        f"{root}/documents.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out = [("documents", docs.columns, [r.asDict() for r in docs.collect()])]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, root).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append((name, docs.columns, [r.asDict() for r in docs.collect()]))
    return root, {name: (cols, rows) for name, cols, rows in out}


def bag(rows, *cols):
    return Counter(tuple(r[c] for c in cols) for r in rows)


def test_columns(stages):
    _, of = stages
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert of[name][0] == of["documents"][0]


def test_language_id_rejects_what_has_no_letter(stages):
    _, of = stages
    before, after = of["documents"][1], of["language_id"][1]
    want = [r for r in before if r["text"] is not None and any(c.isalpha() for c in r["text"])]
    assert bag(after, *of["documents"][0]) == bag(want, *of["documents"][0])
    assert len(before) - len(want) == 3


def test_near_dedup_keeps_one_of_each_group(stages):
    _, of = stages
    before, after = of["language_id"][1], of["near_dedup"][1]
    far = 10 ** 6
    rows = sorted(((far if r["doc_id"] is None else r["doc_id"], r["text"]) for r in before), key=str)
    want = {g for g in groups(rows)}
    assert Counter(far if r["doc_id"] is None else r["doc_id"] for r in after) == Counter(want)
    texts = {(r["doc_id"], r["text"]) for r in before}
    assert all((r["doc_id"], r["text"]) in texts for r in after)
    assert len(after) < len(before)


def test_repeat_removal(stages):
    _, of = stages
    before, after = of["near_dedup"][1], of["repeat_removal"][1]
    bodies = [r["text"].encode() for r in before]
    seen = Counter(b[i:i + 200] for b in bodies for i in range(len(b) - 199))
    want = []
    for r, b in zip(before, bodies):
        gone = [False] * len(b)
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = [True] * 200
        text = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        want.append(r | {"text": text, "n_chars": len(text)})
    assert bag(after, *of["documents"][0]) == bag(want, *of["documents"][0])
    assert any(len(r["text"]) < len(b) for r, b in zip(want, bodies))


def test_source_mix_takes_each_source_near_its_target(stages):
    _, of = stages
    before, after = of["repeat_removal"][1], of["source_mix"][1]
    cols = of["documents"][0]
    taken, given = bag(after, *cols), bag(before, *cols)
    assert set(taken) <= set(given) and all(n <= 2 * given[r] for r, n in taken.items())
    at, src = cols.index("text"), cols.index("source")
    size = lambda row: len(row[at].split())
    of_source = Counter()
    for row, n in given.items():
        of_source[row[src]] += n * size(row)
    order = sorted(of_source, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1] * 9))
    target, open_, rest = {}, set(order), 1.5 * sum(of_source.values())
    while open_:
        parts = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if parts[s] > 2 * of_source[s]}
        if not over:
            target |= parts
            break
        target |= {s: 2 * of_source[s] for s in over}
        rest -= sum(2 * of_source[s] for s in over)
        open_ -= over
    got = Counter()
    for row, n in taken.items():
        got[row[src]] += n * size(row)
    longest = max(size(r) for r in given)
    assert all(abs(got[s] - target[s]) <= longest for s in order)


def test_encoding_as_the_library_has_it(stages):
    _, of = stages
    before, after = of["source_mix"][1], of["encoding"][1]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in before:
        ids = lib.encode_ordinary(r["text"])
        want[(r["doc_id"], r["source"], len(ids), b"".join(i.to_bytes(4, "little") for i in ids),
              hashlib.sha256(r["text"].encode()).hexdigest())] += 1
    got = Counter((r["doc_id"], r["source"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in after)
    assert got == want


def test_run_is_its_stages(spark, stages):
    root, of = stages
    again = [r.asDict() for r in corpus_pipeline.run(spark, root).collect()]
    key = lambda rows: Counter((r["doc_id"], r["source"], r["n_tokens"], bytes(r["ids"])) for r in rows)
    assert key(again) == key(of["encoding"][1])


def test_run_leaves_its_last_stage_only(spark, stages):
    from tillkit.llm.common import shared_dir

    root, _ = stages
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    corpus_pipeline.run(spark, root)
    new = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert [n.split("-")[1] for n in new if n.startswith(("stage-", "scratch-"))] == ["encoding"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_encoding_is_turned_back(spark, frame):
    texts = ["plain words", "", None, "Ünïcode 日本 \U0001f600", " \n\n x  ", "a" * 500, "plain words"]
    docs = frame([(i, t, "web") for i, t in enumerate(texts)], "doc_id long, text string, source string", {"ids": 1})
    got = {r.doc_id: r for r in corpus_pipeline.encoding(spark, docs, "").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):  # a null text has no ids
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
