"""Quality by votes of the nearest labelled documents in a latent space.

A text's terms are the hashed byte trigrams of its shape (letters, capitals,
digits, signs and breaks, whatever the language) and its repetitions (words
that repeat the word before, lines seen before). Weights are sublinear tf-idf
with document frequencies over all documents. The latent space is the
truncated singular value decomposition of labelled documents: a bounded sample
of them, ``SAMPLE`` of each label, the least by a hash of the id.

The sample's latent vectors are broadcast (``2 * SAMPLE * RANK`` numbers).
Every document is projected, its cosines with all of them are computed exactly
in blocks, and the ``NEIGHBOURS`` nearest vote for their labels, weighted by
similarity. A document without terms, or without a near neighbour, scores the
share of label 1 in the sample; with no labelled rows the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillkit.llm.common import free_names, ship

TERMS = 4096
REPEATS = 4
SAMPLE = 1024
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 8
CUT = 0.3


def _shape(b: int) -> int:
    """Class of a byte: letter, capital, digit, blank, break or the sign itself."""
    c = chr(b)
    if b >= 0x80 or c.islower():
        return ord("a")
    if c.isupper():
        return ord("A")
    if c.isdigit():
        return ord("0")
    return ord("\n") if c in "\r\n" else b if b > 0x20 else 0x20


_SHAPES = bytes(_shape(b) for b in range(256))


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a text, in order, and how often each occurs."""
    body = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(b"\n" + body.translate(_SHAPES) + b"\n", dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] << 14) | (b[1:-1] << 7) | b[2:]
    count = np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=TERMS)
    words = body.split()
    lines = [x for x in body.split(b"\n") if x.strip()]
    twice = sum(a == b for a, b in zip(words, words[1:]))
    extra = [twice, len(lines) - len(set(lines)),
             max(0, len(words) // 2 - len(set(words))), sum(len(w) > 30 for w in words)]
    count = np.concatenate([count[:TERMS - REPEATS], extra])
    at = np.flatnonzero(count)
    return at, count[at]


def weights(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit tf-idf weights of a document's terms."""
    w = (1.0 + np.log(count)) * idf[at]
    return w / max(np.sqrt(w @ w), 1e-12)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TERMS + 1, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen[terms(t or "")[0]] += 1
                seen[TERMS] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(TERMS + 1), pa.int32()), pa.array(seen)], ["term", "n"])

    sums = docs.select(F.col(text).alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(
        F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS + 1, dtype=np.int64)
    out[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return out[:TERMS], int(out[TERMS])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", sample: int = SAMPLE) -> dict:
    """Model from all documents' term counts and a bounded sample of labels.

    ``labels`` has one row per labelled document (null labels are skipped; of
    several labels of one id the least counts, and of several texts the one of
    least hash).
    """
    ship(docs.sparkSession)
    frequency, n = document_frequencies(docs, text)
    idf = np.log((n + 1) / (frequency + 1)) + 1.0
    one = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(
        F.col(doc_id).alias("id")).agg(F.min(label).alias("label"))
    some = [one.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(sample) for v in (0, 1)]
    picked = some[0].unionByName(some[1])
    rows = (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")
            .groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
            .select("id", "label", "least.text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())),
                 pa.array([c.tolist() for _, c in found], pa.list_(pa.int64()))], ["id", "label", "at", "n"])

    got = (rows.select("text", F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"))
           .mapInArrow(run, "id long, label long, at array<int>, n array<long>")
           .toPandas().sort_values("id"))
    if not len(got):
        return {"idf": idf, "basis": None, "prior": 0.5}
    x = np.zeros((len(got), TERMS))
    for i, (at, c) in enumerate(zip(got["at"], got["n"])):
        if len(at):
            x[i, at] = weights(np.asarray(at), np.asarray(c), idf)
    value, vector = np.linalg.eigh(x @ x.T)
    top = np.argsort(value)[::-1][:RANK]
    top = top[value[top] > 1e-9]
    basis = (x.T @ vector[:, top]) / np.sqrt(value[top])
    latent = x @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    y = got["label"].to_numpy().astype(float)
    return {"idf": idf, "basis": basis, "latent": latent, "y": y, "prior": float(y.mean())}


def vote(vectors: np.ndarray, model: dict) -> np.ndarray:
    """Scores of latent vectors, by exact cosines with every labelled one."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = (vectors / np.maximum(norm, 1e-12)) @ model["latent"].T
    k = min(NEIGHBOURS, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    sim = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0) ** SHARPNESS
    total = sim.sum(1)
    votes = (sim * model["y"][near]).sum(1)
    return np.where(total > 1e-12, votes / np.maximum(total, 1e-12), model["prior"]).clip(0.0, 1.0)


def score(docs: DataFrame, model: dict, text: str = "text", block: int = 512) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.3)."""
    spark = docs.sparkSession
    ship(spark)
    names = free_names(docs, "score", "predicted")
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()),
                           T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            out = np.full(len(texts), m["prior"])
            for lo in range(0, len(texts) if m["basis"] is not None else 0, block):
                part = texts[lo:lo + block]
                vectors = np.zeros((len(part), m["basis"].shape[1]))
                for i, t in enumerate(part):
                    at, count = terms(t or "")
                    if len(at):
                        vectors[i] = weights(at, count, m["idf"]) @ m["basis"][at]
                out[lo:lo + block] = vote(vectors, m)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out), pa.array((out >= CUT).astype(np.int32))],
                [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
