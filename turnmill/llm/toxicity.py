"""Toxicity from subword-bag embeddings under a linear softmax.

A word is the bag of itself and its character n-grams, each hashed into a table of embeddings.
A document is the average of its words' vectors, a word's vector the average of its bag, and a
softmax over two classes reads the document.  Embeddings and softmax are trained jointly by Adam
in numpy, so a misspelt word that was never seen shares most of its n-grams' vectors with the
word it is made from.  Once trained, the softmax's difference is folded into the table: a
word's contribution to the logit is then one number, and scoring adds those up.

Learning reads at most `max_documents` labelled documents (those of least hash of doc_id), whole
texts, only where crc32(doc_id as text) mod 4 is not 2.  Scores depend on the text alone.  A
null or empty text, or one without words, scores as the bias does.  Repeated label rows count
as one (toxic if any says so); a null label is no label.  Without labels of both classes every
score is the share of toxic ones among the labels, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import row_of, text_of
from .shingles import mix, words_of

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 4, 3, 6
MAX_DOCUMENTS = 8000
THRESHOLD = 0.3
_STRIPPED = ".,;:!?\"'()[]{}*$%&#|<>-_"
_PRIME = np.uint64(0x100000001B3)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Table rows and the numbers of the words they belong to: of the words themselves, then of their n-grams, one length after the other."""
    if not words:
        return
    yield (pd.util.hash_array(np.array(words, dtype=object), categorize=False) % np.uint64(BUCKETS)).astype(np.int32), np.arange(len(words), dtype=np.int32)
    letters = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    rolled = letters
    for n in range(2, LONGEST + 1):
        if n > len(letters):
            break
        rolled = rolled[:-1] * _PRIME + letters[n - 1 :]
        if n >= SHORTEST:
            inside = np.flatnonzero(word[: len(rolled)] == word[n - 1 :])
            yield (mix(rolled[inside] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32), word[inside]


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of every word and its n-grams, one word after the other, and where each word's begin (one end more)."""
    parts = list(grams(words))
    if not parts:
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    owner = np.concatenate([p[1] for p in parts])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([p[0] for p in parts])[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (lower case, without marks around them), each word's number, and how many words each text has."""
    coded, counts = words_of(texts)
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), _STRIPPED).dictionary_encode()
    return plain.dictionary.to_pylist(), plain.indices.to_numpy()[coded.indices.to_numpy()], counts


@dataclass
class Model:
    """table: each row's part of the logit; a document's logit is bias + the mean over words of the mean over their rows."""

    table: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, index, counts = cut(texts)
        worth, size = np.zeros(len(words)), np.zeros(len(words))
        for rows, owner in grams(words):  # one length at a time, so memory stays small
            worth += np.bincount(owner, self.table[rows], len(words))
            size += np.bincount(owner, minlength=len(words))
        worth /= np.maximum(1, size)
        upto = np.concatenate([[0.0], np.cumsum(worth[index])])
        ends = np.cumsum(counts)
        logit = self.bias + (upto[ends] - upto[ends - counts]) / np.maximum(1, counts)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def weighted_bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's table rows with their weights in the average, and where each text's begin (one end more)."""
    words, index, counts = cut(texts)
    rows, at = bags(words)
    size = np.diff(at)
    kept_rows, kept_weights, begins = [], [], [0]
    upto = np.concatenate([[0], np.cumsum(counts)])
    for k in range(len(counts)):
        used, times = np.unique(index[upto[k] : upto[k + 1]], return_counts=True)
        length = size[used]
        places = np.repeat(at[used] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        distinct, which = np.unique(rows[places], return_inverse=True)
        kept_rows.append(distinct.astype(np.int32))
        kept_weights.append(np.bincount(which, np.repeat(times / (max(1, counts[k]) * length), length), len(distinct)).astype(np.float32))
        begins.append(begins[-1] + len(distinct))
    return np.concatenate(kept_rows or [np.empty(0, np.int32)]), np.concatenate(kept_weights or [np.empty(0, np.float32)]), np.array(begins)


def train(texts: pa.Array | list[pa.Array], toxic: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax by Adam on the cross-entropy."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), -30.0 if share == 0 else 30.0)
    parts = [weighted_bags(t) for t in (texts if isinstance(texts, list) else [texts])]
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    rows, weights = np.empty(at[-1], np.int32), np.empty(at[-1], np.float32)
    begin = 0
    while parts:
        row, weight, _ = parts.pop(0)
        rows[begin : begin + len(row)], weights[begin : begin + len(row)] = row, weight
        begin += len(row)
    random = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, DIM), np.float32)
    top, bias = (random.standard_normal((DIM, 2)) * 0.5).astype(np.float32), np.log([1 - share, share]).astype(np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (table, top, bias)]
    full = np.flatnonzero(np.diff(at))
    step = 0
    for epoch in range(epochs):
        order = random.permutation(full)
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            step += 1
            length = np.diff(at)[docs]
            places = np.repeat(at[docs] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            row, weight = rows[places], weights[places]
            hidden = np.add.reduceat(table[row] * weight[:, None], np.cumsum(length) - length)
            z = hidden @ top + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), toxic[docs]] -= 1
            p /= len(docs)
            back = p @ top.T
            moved = np.stack([np.bincount(row, weight * np.repeat(back[:, d], length), BUCKETS) for d in range(DIM)], 1).astype(np.float32)
            now = rate * (1 - epoch / epochs)
            for x, s, (m, v) in zip((table, top, bias), (moved, hidden.T @ p, p.sum(0)), state, strict=True):
                m += 0.1 * (s - m)
                v += 0.01 * (s * s - v)
                x -= now * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + decay * x)
    return Model(table @ (top[:, 1] - top[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS) -> Model:
    """A model of the labelled documents that are not held out."""
    known = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"])).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)  # so many (id, label) rows at most
    texts = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").limit(max_documents)

    def learn(batches):
        # one task holds the sample, of bounded size; should it be lost, Spark runs it again
        parts = [b.slice(k, 250) for b in batches for k in range(0, b.num_rows, 250)]
        toxic = np.concatenate([p.column("_toxic").to_numpy() for p in parts] or [np.empty(0)]).astype(np.int64).clip(0, 1)
        model = train([p.column("text") for p in parts], toxic)
        yield pa.RecordBatch.from_pydict({"table": pa.array([model.table.astype("<f4").tobytes()], pa.binary()), "bias": [model.bias]})

    model = texts.select("text", F.col("_toxic").cast("int").alias("_toxic")).coalesce(1).mapInArrow(learn, "table binary, bias double").first()
    return Model(np.frombuffer(model["table"], "<f4"), model["bias"])


def scored(docs: DataFrame, model: Model, rows_at_once: int = 1000) -> DataFrame:
    """row (all columns of docs), score (0 to 1) and predicted (1 from THRESHOLD on)."""

    def add(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, rows_at_once):
                part = batch.column("row").slice(k, rows_at_once)
                score = model.scores(pc.struct_field(part, "text"))
                yield pa.RecordBatch.from_pydict({"row": part, "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

    rows = docs.select(row_of(docs).alias("row"))
    return rows.mapInArrow(add, StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
