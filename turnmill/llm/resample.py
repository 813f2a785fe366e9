"""Quality by importance resampling (Xie et al. 2023).

Two generative models over hashed words and word pairs, one of target text and one of raw text,
give each document a log weight: the sum over its n-grams of the log ratio of their
probabilities.  Gumbel noise is added, drawn from a hash of doc_id, and the k greatest keys are
kept, which samples k documents without replacement in proportion to their weights.

The raw model counts all documents; the target model counts labelled ones of quality 1 that are
not held out (crc32 of doc_id as text mod 4 is 2), the `MAX_TARGET` of least hash if there are more; counts are summed by bucket before they are
shuffled, and only the table of `BUCKETS` log ratios reaches the driver.  k is the labels' share
of quality 1 times the number of documents.  The k-th key is found by histograms of the keys, so
no sort of all documents is made; ties go to the smaller doc_id.

A null or empty text has weight 0.  A null doc_id stands first among equals.  Repeated rows have one key
and are kept or left together.  Without labels, weights are 0 and every document is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of
from .shingles import mix, word_hashes, words_of
from .toxicity import held_out

BUCKETS = 1 << 15
#: Labelled documents that the target model counts, at most; so many ids are broadcast.
MAX_TARGET = 50_000


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every text's words and word pairs (0 where a text ends), two for each word, and the words of each text."""
    words, counts = words_of(texts)
    hashes = word_hashes(words)
    one = (mix(hashes + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    pair = np.full(len(hashes), -1, np.int64)
    if len(hashes) > 1:
        pair[:-1] = (mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) % np.uint64(BUCKETS)).astype(np.int64)
        ends = np.cumsum(counts[counts > 0]) - 1
        pair[ends] = -1
    return np.stack([one, pair], 1), counts


def log_ratios(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Each bucket's log ratio of target to raw probability, and the share of quality 1 among the labels."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))).first()
    target = known.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TARGET).select("doc_id", F.lit(True).alias("_target"))
    both = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(target), "doc_id", "left").select("text", F.coalesce("_target", F.lit(False)).alias("_target"))

    def count(batches):
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            grams, counts = ngrams(batch.column("text"))
            of = np.repeat(batch.column("_target").to_numpy(zero_copy_only=False).astype(bool), counts)
            for kind, part in ((0, grams), (1, grams[of])):
                flat = part.ravel()
                sums[kind] += np.bincount(flat[flat >= 0], minlength=BUCKETS)
        for kind in (0, 1):
            used = np.flatnonzero(sums[kind])
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(used), kind, np.int32)), "bucket": pa.array(used), "n": pa.array(sums[kind][used])})

    rows = both.mapInArrow(count, "kind int, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect()  # at most 2 * BUCKETS rows
    table = np.zeros((2, BUCKETS))
    for kind, bucket, many in rows:
        table[kind, bucket] = many
    if not good or not table[1].any():
        return np.zeros(BUCKETS), 1.0
    chance = (table + 1) / (table + 1).sum(1, keepdims=True)
    return np.log(chance[1] / chance[0]), good / n


def weighted(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id and log_weight of every document."""

    def weigh(batches):
        for batch in batches:
            grams, counts = ngrams(batch.column("text"))
            worth = np.where(grams >= 0, ratios[grams], 0.0).sum(1)
            upto = np.concatenate([[0.0], np.cumsum(worth)])
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "log_weight": pa.array(np.round(upto[ends] - upto[ends - counts], 6))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(weigh, "doc_id long, log_weight double")


def greatest(rows: DataFrame, k: int, bins: int = 1024, few: int = 10_000) -> DataFrame:
    """rows (doc_id, key) with kept: whether the key is among the k greatest."""
    lo, hi, n = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k >= n:
        return rows.withColumn("kept", F.lit(True))
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    inside, above = n, 0
    while inside > few and hi > lo:
        width = (hi - lo) / bins
        if lo + width <= lo:
            break
        place = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1)).cast("int")
        counts = {r[0]: (r[1], r[2], r[3]) for r in rows.where(F.col("key").between(lo, hi)).groupBy(place.alias("b")).agg(F.count("*"), F.min("key"), F.max("key")).collect()}  # at most `bins` rows
        for b in sorted(counts, reverse=True):
            if above + counts[b][0] >= k:
                inside, lo, hi = counts[b]
                break
            above += counts[b][0]
    last = rows.where(F.col("key").between(lo, hi)).select("key", "doc_id").orderBy(F.desc("key"), F.asc_nulls_first("doc_id")).limit(k - above)
    key, doc_id = last.orderBy(F.asc("key"), F.desc_nulls_last("doc_id")).first()
    tied = F.lit(doc_id is None) if doc_id is None else F.coalesce(F.col("doc_id") <= doc_id, F.lit(True))
    return rows.withColumn("kept", (F.col("key") > key) | ((F.col("key") == key) & tied))


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, key, kept for every document; `share` of them are kept (by default the labels' share of quality 1)."""
    ratios, good = log_ratios(docs, labels)
    unit = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("gumbel")), 12) + F.lit(0.5)) * F.lit(2.0**-52)
    rows = saved(weighted(docs, ratios).withColumn("key", F.round(F.col("log_weight") - F.log(-F.log(unit)), 6)), "keys")
    return greatest(rows, round(rows.count() * (good if share is None else share)))
