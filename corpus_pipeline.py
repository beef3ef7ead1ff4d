"""A corpus pipeline: language ID, near-dedup, repeat removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillkit.llm import byte_bpe, language_mix, mixing, near_dup, suffix_dedup
from tillkit.llm.common import read, remove, scratch, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts and texts without a letter go.

    Repeated rows and extra columns stay as they are, an empty table stays
    empty. (The operator's new columns stand behind those of ``docs``, under
    names that do not clash: held_out, lang_pred and more.)
    """
    found = language_mix.identify(docs)
    predicted = found.columns[len(docs.columns) + 1]
    return found.where(F.col(predicted) != language_mix.UNKNOWN).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: least id, then least text hash.

    Null texts stay; of repeated rows one stays; extra columns stay.
    """
    return near_dup.drop_near_duplicates(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated 200-byte strings.

    A character that lost some of its bytes goes too. Null texts stay null,
    repeated rows lose the same, extra columns stay. (What is left stands behind
    the columns of ``docs``, under a name that does not clash.)
    """
    left = suffix_dedup.remove_repeats(docs, as_text=True)
    kept = F.col(left.columns[len(docs.columns)])
    new = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return left.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard.

    Texts that are null or without a word have no size and are not taken; a null
    source is a source of its own; an empty table gives an empty mix.
    """
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids, their number and a digest of the bytes they decode to, for every document of the mix.

    A null text has no ids, as an empty one.
    """
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.encode_and_decode(docs.select("doc_id", "source", "text"), ranks)
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("repeat_removal", repeat_removal),
          ("source_mix", source_mix), ("encoding", encoding)]

#: Hash sketches, suffix order and BPE are outside SQL; tests/llm/test_pipeline.py holds every stage of a run
#: against a plain form of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again.

    A stage's own files, and the stage before, are deleted when it is written.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
