"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and
returns a DataFrame; all but the last return the columns of `documents`.

Nulls: a null text is never toxic, is linked with nothing and stays as it is; a null doc_id is
linked with nothing.  Rows equal in doc_id and text leave the duplicate stage once; rows of one
doc_id with different texts are judged each by its text.  Columns of any name go through every
stage but the last, and so does an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import minhash, mixing, packing, pii, toxicity
from turnmill.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words link at a similarity of 0.8 or more: the one of least doc_id."""
    return minhash.one_of_each(docs, width=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and n_chars after it."""
    done = pii.redacted(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emitted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    digest = cut.select("doc_id", "piece", "start", "length", "part", "nth", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained stages and the tokenizer; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
