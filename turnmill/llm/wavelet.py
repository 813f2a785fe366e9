"""Token ids of whole texts in wavelet-matrix files.

`write_shards` deals documents out by ranges of doc_id, encodes every whole text, appends
the end id, and writes one Parquet row for each block of about `block_tokens` ids.  The
row's `payload` is a complete wavelet file: magic, section lengths, the documents' ids and
sizes, and one bit-plane for each bit of an id, each compressed with zstd.
`WaveletMatrix` answers access, rank, select, count and occurrences from such a payload
without the text; `read_documents` gives back each document's ids.

Nulls: a null text is empty (it has the end id alone); a null doc_id sorts first.  Equal
doc_ids stand in the order of their texts' hashes.  An empty table gives an empty shard table.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of
from .tokens import encoder, runs

END_ID = 0
MAGIC = b"WVM1"
_WORD = 512  # bits between two entries of the rank directory
SHARD = "shard int, block int, n_docs long, n_tokens long, payload binary"


class WaveletMatrix:
    """Rank and select over a sequence of ids of `bits` bits, from bit-planes."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.bits, self.zeros = n, len(planes), zeros
        self.planes = [np.concatenate([p, np.zeros(-len(p) % (_WORD // 8), np.uint8)]) for p in planes]
        self.ones_before = [np.concatenate([[0], np.cumsum(np.bitwise_count(p.view(np.uint64)).reshape(-1, _WORD // 64).sum(1, dtype=np.int64))]) for p in self.planes]

    @classmethod
    def of(cls, ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        planes, zeros = [], []
        now = np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits):
            one = (now & now.dtype.type(1 << (bits - 1 - level))) != 0
            planes.append(np.packbits(one, bitorder="little"))
            low = now[~one]
            zeros.append(len(low))
            now = np.concatenate([low, now[one]])
        return cls(len(ids), planes, zeros)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        word, plane = i // _WORD, self.planes[level]
        part = np.unpackbits(plane[word * _WORD // 8 : (i + 7) // 8], bitorder="little")[: i - word * _WORD]
        return int(self.ones_before[level][word]) + int(part.sum())

    def _position(self, level: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) such bit of a plane stands."""
        before = self.ones_before[level] if bit else np.arange(len(self.ones_before[level])) * _WORD - self.ones_before[level]
        word = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][word * _WORD // 8 : (word + 1) * _WORD // 8], bitorder="little")
        return word * _WORD + int(np.flatnonzero(part == bit)[k - int(before[word])])

    def access(self, i: int) -> int:
        out = 0
        for level in range(self.bits):
            ones = self._ones(level, i)
            bit = int(self.planes[level][i // 8] >> (i % 8)) & 1
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            if symbol >> self.bits:
                return 0, 0
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """How often the symbol stands among the first i."""
        return self.count(symbol, 0, i)

    def count(self, symbol: int, lo: int, hi: int) -> int:
        a, b = self._range(symbol, lo, hi)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """Where the symbol stands for the k-th time, from 0."""
        a, b = self._range(symbol, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(self.bits)):
            bit = symbol >> (self.bits - 1 - level) & 1
            i = self._position(level, bit, i - self.zeros[level] * bit)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol, 0, self.n))]

    def decode(self) -> np.ndarray:
        """All symbols at once, from the last plane to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in reversed(range(self.bits)):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            out = np.empty_like(now)
            out[~one] = now[: self.zeros[level]]
            out[one] = now[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            now = out
        return now


def to_payload(doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: int = 16) -> bytes:
    """A wavelet file: the head, then the sections, each compressed."""
    import zstandard

    matrix, pack = WaveletMatrix.of(ids, bits), zstandard.ZstdCompressor(level=1).compress
    parts = [doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), sizes.astype("<i8").tobytes()]
    parts += [p[: (len(ids) + 7) // 8].tobytes() for p in matrix.planes]
    packed = [pack(p) for p in parts]
    head = struct.pack(f"<4sqqi{bits}q{len(packed)}q", MAGIC, len(doc_ids), len(ids), bits, *matrix.zeros, *map(len, packed))
    return head + b"".join(packed)


def from_payload(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """doc_ids, which of them are not null, sizes, and the matrix of a wavelet file."""
    import zstandard

    magic, n_docs, n, bits = struct.unpack_from("<4sqqi", payload)
    if magic != MAGIC:
        raise ValueError("not a wavelet file")
    at = struct.calcsize("<4sqqi")
    numbers = struct.unpack_from(f"<{bits}q{bits + 3}q", payload, at)
    at += 8 * len(numbers)
    unpack, parts = zstandard.ZstdDecompressor().decompress, []
    for k in numbers[bits:]:
        parts.append(unpack(payload[at : at + k]))
        at += k
    planes = [np.frombuffer(p, np.uint8) for p in parts[3:]]
    return np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "u1").astype(bool), np.frombuffer(parts[2], "<i8"), WaveletMatrix(n, planes, list(numbers[:bits]))


def write_shards(docs: DataFrame, path: str, tokenizer: str, block_tokens: int = 1 << 20, rows_at_once: int = 4000) -> None:
    """Encodes whole texts and writes the shard table (columns of SHARD) as Parquet at `path`."""

    def build(batches):
        shard, block, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            docs_, known, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            payload = to_payload(docs_, known, sizes, ids)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "n_docs": [len(docs_)], "n_tokens": [len(ids)], "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for k in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(k, rows_at_once)
                ids, counts = encoder(tokenizer).encode(part.column("text"))
                sizes = counts + 1
                whole = np.full(len(ids) + len(sizes), END_ID, ids.dtype)
                whole[runs(np.cumsum(sizes) - sizes, counts)] = ids
                doc = part.column("doc_id")
                held_docs, known = doc.fill_null(0).to_numpy(zero_copy_only=False), ~np.asarray(doc.is_null())
                # a block ends with the document that fills it
                group = (n + np.cumsum(sizes) - sizes) // block_tokens
                cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
                upto = np.concatenate([[0], np.cumsum(sizes)])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a:
                        yield flush()
                        held, n, block = [], 0, block + 1
                    held.append((held_docs[a:b], known[a:b], sizes[a:b], whole[upto[a] : upto[b]]))
                    n += int(upto[b] - upto[a])
                if n >= block_tokens:
                    yield flush()
                    held, n, block = [], 0, block + 1
        if held:
            yield flush()

    source = docs.select("doc_id", text_of(docs).alias("text"))
    ranged = source.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    ranged.drop("_h").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(build, SHARD).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, block, start in the block, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers), from the files."""

    def read(batches):
        for batch in batches:
            for shard, block, payload in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                doc_ids, known, sizes, matrix = from_payload(payload.as_buffer().to_pybytes())
                ids = memoryview(matrix.decode().astype("<u4")).cast("B")
                upto = np.concatenate([[0], np.cumsum(sizes)])
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, mask=~known), "shard": pa.array(np.full(len(sizes), shard, np.int32)), "block": pa.array(np.full(len(sizes), block, np.int32)), "block_start": pa.array(upto[:-1]), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(sums, pa.int64())})

    return spark.read.parquet(path).select("shard", "block", "payload").mapInArrow(read, "doc_id long, shard int, block int, block_start long, n_tokens long, ids_crc32 long")


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each block: sums of whole shards (as many as the write had partitions) and, within a shard, of its blocks."""
    blocks = spark.read.parquet(path).select("shard", "block", "n_tokens")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = shards.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before"))
    inside = blocks.withColumn("_in", F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens"))
    return inside.join(before, "shard").select("shard", "block", (F.col("_before") + F.col("_in")).alias("_start"))


def documents_from_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from the files."""
    docs = read_documents(spark, path).join(block_starts(spark, path), ["shard", "block"])
    return docs.select("doc_id", (F.col("_start") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32")
