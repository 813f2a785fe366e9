"""Stupid-backoff scores (Brants et al. 2007), counted from all documents.

The score of a word after the `order` - 1 words before it is c(these words and it) / c(these
words) where the n-gram occurs `least` times or more in the corpus, else 0.4 times its score after
one word less; a word alone scores c(w) / N.  Near a text's begin there are fewer words before it.
A document's score is the sum of the logarithms, and their mean.

Documents are read in blocks.  A block's distinct n-grams of each order are exploded as sorted
64-bit hashes, each with its number in the block, and dealt out by hash bucket.  A bucket adds up
the numbers of all blocks, which is its part of the count tables (`count_tables` gives them as
rows), and joins the totals to the blocks' n-grams on the whole hash; count and join share the
bucket's task, so the exploded n-grams are shuffled once.  Then each block sums its documents'
scores.  An n-gram that a third of all documents hold is one entry a block, and a bucket's size
doesn't grow with the corpus, since the number of buckets does.

A null or empty text has no words: score 0, mean null.  A null doc_id is carried along.  Repeated
rows are counted and scored each for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of
from .shingles import bounded, mix, word_hashes, words_of

BLOCK_ROWS, BLOCK_BYTES, BUCKET_WORDS, ROWS_AT_ONCE = 4096, 16 << 20, 1_000_000, 512
FACTOR, LEAST = 0.4, 2
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = "block long, doc_ids array<long>, sizes array<int>, vocab binary, words binary, n long"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as zstd-compressed byte planes: what few high bytes say takes next to no room."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def steps(rising: np.ndarray) -> np.ndarray:
    """The first of rising numbers, then the differences."""
    return np.diff(rising, prepend=rising.dtype.type(0))


def blocks(docs: DataFrame, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> DataFrame:
    """Documents in blocks: their ids and sizes, the hashes of the block's words, and each word as its place among them.

    A block has at most so many rows and bytes of text (one longer text is a block); its words are cut and hashed a part at a time.
    """

    def cut(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in bounded(batch, "text", rows, size):
                hashes, counts = [], []
                for k in range(0, some.num_rows, ROWS_AT_ONCE):
                    words, each = words_of(some.slice(k, ROWS_AT_ONCE).column("text"))
                    hashes.append(word_hashes(words))
                    counts += each.tolist()
                vocab, place = np.unique(np.concatenate(hashes), return_inverse=True)
                values = [[part << 32 | n], [some.column("doc_id").to_pylist()], [counts], [packed(steps(vocab))], [packed(place)], [len(place)]]
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["block", "doc_ids", "sizes", "vocab", "words", "n"])
                n += 1

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return saved(source.mapInArrow(cut, _BLOCK), "blocks")


def _grams(vocab: np.ndarray, words: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the hashes of the n-grams that end in each word (0 where the text began too late)."""
    one = vocab[words]
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(one)) - np.repeat(begins, sizes)
    out = [one]
    for n in range(2, order + 1):
        gram = np.zeros(len(one), np.uint64)
        if len(one) > 1:
            gram[1:] = mix(out[-1][:-1] * _PAIR + one[1:]) | np.uint64(1)
        gram[place < n - 1] = 0
        out.append(gram)
    return out


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in the order of bucket and hash, how often each stands there, its place for every input, and where buckets begin."""
    keys, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    # buckets are ranges of the hash, so the order by hash is the order by bucket
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return keys, counts, place, np.searchsorted(bucket, np.arange(buckets + 1))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(unpacked(row["vocab"]), dtype=np.uint64), unpacked(row["words"]).astype(np.int64), np.array(row["sizes"], np.int64)


def _exploded(held: DataFrame, order: int, buckets: int) -> DataFrame:
    """gram_order, bucket, block, keys (the block's distinct n-grams of the bucket, from its least hash on, as steps) and counts."""

    def explode(batches):
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):  # one block at a time
                for n, grams in enumerate(_grams(*_unpacked(row), order), 1):
                    keys, counts, _, at = _dealt(grams[grams != 0] if n > 1 else grams, buckets)
                    used = np.flatnonzero(np.diff(at))
                    low = [packed(steps(keys[at[b] : at[b + 1]] - _bottom(b, buckets))) for b in used.tolist()]
                    many = [packed(counts[at[b] : at[b + 1]]) for b in used.tolist()]
                    yield pa.RecordBatch.from_pydict({"gram_order": pa.array(np.full(len(used), n, np.int32)), "bucket": pa.array(used), "block": pa.array(np.full(len(used), row["block"])), "keys": pa.array(low, pa.binary()), "counts": pa.array(many, pa.binary())})

    return held.select("block", "sizes", "vocab", "words").mapInArrow(explode, "gram_order int, bucket long, block long, keys binary, counts binary")


def _bottom(bucket: int, buckets: int) -> np.uint64:
    """The least hash of a bucket."""
    return np.uint64(-(-(bucket << 32) // buckets) << 32)


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's distinct keys with their totals, and each given key's place among them and how many each row has."""
    keys, counts = ([unpacked(v.as_py()) for v in table.column(c)] for c in ("keys", "counts"))
    distinct, place = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k in keys]), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts)).astype(np.int64), place, np.array([len(k) for k in keys])


def _plan(docs: DataFrame, order: int, rows: int, bucket_words: int) -> tuple[DataFrame, int, int]:
    """The blocks, how many words they have, and how many buckets n-grams are dealt to."""
    held = blocks(docs, rows)
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return held, total, max(16, -(-total // bucket_words))


def count_tables(docs: DataFrame, order: int = 2, rows: int = BLOCK_ROWS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """gram_order, gram (its hash as a long) and n of every n-gram of the documents."""
    held, _, buckets = _plan(docs, order, rows, bucket_words)

    def count(table: pa.Table) -> pa.Table:
        keys, totals, _, _ = _counted(table)
        n, bucket = table.column("gram_order")[0].as_py(), table.column("bucket")[0].as_py()
        return pa.table({"gram_order": pa.array(np.full(len(keys), n, np.int32)), "gram": pa.array((keys + _bottom(bucket, buckets)).view(np.int64)), "n": pa.array(totals)})

    return _exploded(held, order, buckets).groupBy("gram_order", "bucket").applyInArrow(count, "gram_order int, gram long, n long")


def scores(docs: DataFrame, order: int = 2, rows: int = BLOCK_ROWS, bucket_words: int = BUCKET_WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, log_score (the sum) and mean_score of every document."""
    held, total, buckets = _plan(docs, order, rows, bucket_words)

    def joined(table: pa.Table) -> pa.Table:
        _, totals, place, sizes = _counted(table)
        cuts, each = np.concatenate([[0], np.cumsum(sizes)]), totals[place]
        return pa.table({"block": table.column("block"), "gram_order": table.column("gram_order"), "bucket": table.column("bucket"), "totals": pa.array([packed(each[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    counted = _exploded(held, order, buckets).groupBy("gram_order", "bucket").applyInArrow(joined, "block long, gram_order int, bucket long, totals binary")

    def score(block: pa.Table, found: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "log_score": []}
        parts: dict[int, list] = {n: [] for n in range(1, order + 1)}
        for n, bucket, values in zip(*(found.column(c).to_pylist() for c in ("gram_order", "bucket", "totals")), strict=True):
            parts[n].append((bucket, values))
        for row in block.to_pylist():  # one block
            vocab, words, sizes = _unpacked(row)
            before, chance = np.full(len(words), max(1, total), np.float64), np.empty(0)
            for n, grams in enumerate(_grams(vocab, words, sizes, order), 1):
                full = grams != 0 if n > 1 else np.ones(len(grams), bool)
                now = np.zeros(len(grams))
                if full.any():
                    totals = np.concatenate([unpacked(v) for _, v in sorted(parts.pop(n))]).astype(np.float64)
                    now[full] = totals[np.unique(grams[full], return_inverse=True)[1]]
                    del totals
                seen = now / np.maximum(1, before)
                chance = seen if n == 1 else np.where(full, np.where(now >= least, seen, FACTOR * chance), chance)
                before = np.concatenate([[1.0], now[:-1]]) if len(now) else now  # of the n words before a word
            upto = np.concatenate([[0.0], np.cumsum(np.log(chance))])
            ends = np.cumsum(sizes)
            out["doc_id"] += row["doc_ids"]
            out["n_words"] += sizes.tolist()
            out["log_score"] += (upto[ends] - upto[ends - sizes]).tolist()
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "log_score": pa.array(out["log_score"], pa.float64())})

    per_doc = held.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, log_score double")
    return per_doc.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")), 6).alias("mean_score"))
