"""Language identification as inference of a mixture of languages.

A language is a distribution over hashed byte trigrams of letters, learned
from labelled texts: counts over all of them, ``BINS`` numbers per language. A
document is a mixture of languages, whose proportions expectation-maximisation
finds from its trigrams' likelihoods. Which languages it has is chosen by
penalised likelihood: from the best single one, the language that raises the
likelihood most is added while the gain exceeds ``PENALTY`` * log(trigrams).
The mixture of all languages bounds every gain, so most documents stop at one.

Predicted is the language of the largest proportion, and the score is that
proportion. A text that is null, has no letter, or meets a model that learned
no language is ``und`` with score 0 and no languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillkit.llm.common import free_names, ship

#: Hashed trigrams of the model; its size is this times the number of languages.
BINS = 1 << 15
PENALTY = 3.0
ROUNDS = 15
UNKNOWN = "und"

_ONLY_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Count of each bin's trigrams; blanks stand for all that is no letter."""
    body = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_ONLY_LETTERS) + b" "
    b = np.frombuffer(body, dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[(code & 0xFFFF) != 0x2020]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(17), minlength=BINS)


def learn(texts: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the share of each bin in each language.

    Counts are summed in tasks and then by Spark; what comes to the driver is
    ``BINS`` numbers per language. Rows without a text or language are no
    examples.
    """
    ship(texts.sparkSession)
    rows = texts.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k not in sums:
                    sums[k] = np.zeros(BINS, dtype=np.int64)
                sums[k] += trigrams(t)
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                ["lang", "bin", "n"])

    counts = (rows.mapInArrow(run, "lang string, bin int, n long")
              .groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counts["lang"].unique())
    shares = np.ones((len(langs), BINS)) * 0.5
    for i, k in enumerate(langs):
        own = counts[counts["lang"] == k]
        shares[i, own["bin"].to_numpy()] += own["n"].to_numpy()
    return langs, shares / shares.sum(1, keepdims=True)


def proportions(weight: np.ndarray, shares: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood and language proportions of trigrams (weight) by EM."""
    k = shares.shape[1]
    pi = np.full(k, 1.0 / k)
    if k > 1:
        total = weight.sum()
        for _ in range(ROUNDS):
            joint = shares * pi
            pi = (weight / joint.sum(1)) @ joint / total
    return float(weight @ np.log(shares @ pi)), pi


def mixture(counts: np.ndarray, shares: np.ndarray, logs: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Languages of a document (indexes, best first) and their proportions."""
    at = np.flatnonzero(counts)
    weight = counts[at].astype(float)
    price = PENALTY * np.log(weight.sum() + 1)
    single = logs[at].T @ weight
    chosen = [int(single.argmax())]
    like, pi = float(single[chosen[0]]), np.ones(1)
    own = shares[at]
    bound = proportions(weight, own)[0] if len(single) > 1 else like
    while len(chosen) < len(single) and bound - like > price:
        best = None
        for k in range(len(single)):
            if k not in chosen:
                got = proportions(weight, own[:, [*chosen, k]])
                if best is None or got[0] > best[0]:
                    best = (*got, k)
        if best[0] - like <= price:
            break
        like, pi = best[0], best[1]
        chosen = [*chosen, best[2]]
    order = np.argsort(-pi, kind="stable")
    return [chosen[i] for i in order], pi[order]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, langs and shares (all languages found)."""
    spark = docs.sparkSession
    ship(spark)
    names = free_names(docs, "lang_pred", "score", "langs", "shares")
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()),
                           T.StructField(names[1], T.DoubleType()),
                           T.StructField(names[2], T.ArrayType(T.StringType())),
                           T.StructField(names[3], T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, shares = sent.value
        by_bin, logs = np.ascontiguousarray(shares.T), np.log(shares.T)
        for batch in batches:
            out = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                if not langs or t is None or not any(map(str.isalpha, t)):
                    out.append((UNKNOWN, 0.0, [], []))
                    continue
                found, pi = mixture(trigrams(t), by_bin, logs)
                out.append((langs[found[0]], float(min(1.0, pi[0])), [langs[k] for k in found], pi.tolist()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()),
                 pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.list_(pa.float64()))],
                [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def fold(doc_id: str = "doc_id") -> Column:
    """Fifth of the corpus that a row belongs to: 0 is held out (null ids: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with held_out and a prediction learned from the other folds."""
    model = learn(docs.where(fold(doc_id) != 0), text, lang)
    (held,) = free_names(docs, "held_out")
    return predict(docs.withColumn(held, F.coalesce(fold(doc_id) == 0, F.lit(False))), model, text)
