"""Exact top-k by inner product with the no-random-access algorithm (Fagin, Lotem and Naor 2003).

Vectors are dealt out in blocks by a hash of their id, queries in groups; each block meets each
group once.  The first block's k-th best score of a query is a bound that the other blocks start
from.  A block sorts its vectors by every component.  For a query the lists are read from
their better ends, step by step in equal depth.  What has been read bounds every vector's score:
from below with the worst entries of the unread lists, from above with the last entries read.
Reading stops once the vectors whose upper bound reaches the k-th best lower bound are few; their
scores are resolved exactly, and a window over the blocks' results keeps k for each query.

Components are whole numbers floor(SCALE * x).  Bounds are doubles, of components scaled to at
most 1, and leave room for rounding; scores are sums of whole numbers, of any size.  A score
beyond 64 bits is ranked by its own value and given as the nearest long.

Left out: null ids, vectors that are null or hold a null or non-finite component, and pairs of
different length (empty vectors score 0 among themselves).  Rows of the query's id are no
candidates for it; of repeated query ids the least vector asks.  Every other row is a candidate of
its own, also where ids or whole rows repeat.  Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cores, saved

SCALE, LEAST_BLOCK, BLOCK, GROUP = 1024, 1024, 65_536, 16_384
_LONG, _DIGITS = 2**63 - 1, 700


def taking_part(vectors: DataFrame, *more: str) -> DataFrame:
    """vec_id and x (and more columns) of those vectors that take part; floats stay floats."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    x = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    good = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), *more).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & good)


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) by scale, which a double holds whatever x is: from 2^44 on, x is a multiple of 1 / 256 already."""
    x = x.astype(np.float64)
    small = np.abs(x) < 2.0**44
    return np.where(small, np.floor(np.where(small, x, 0.0) * scale) / scale, x)


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Quantised components as Python integers."""
    return np.array([int(v * scale) if abs(v) < 2.0**1000 else int(v) * scale for v in x.ravel().tolist()], object).reshape(x.shape)


def exact_scores(x: np.ndarray, q: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Inner products of quantised vectors with a quantised query, as whole numbers."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * scale * scale * max(1, len(q))
    if most < 2.0**62:
        return (x * scale).astype(np.int64) @ (q * scale).astype(np.int64)
    return (whole(x, scale) * whole(q, scale)).sum(1) if len(q) else np.zeros(len(x), np.int64)


def as_columns(scores) -> tuple[list[int], list[str | None]]:
    """The nearest longs, and for whole numbers beyond 64 bits a text that sorts as they do."""
    high = [None if abs(s) <= _LONG else f"+{s:0{_DIGITS}d}" if s > 0 else f"-{10**_DIGITS + s:0{_DIGITS}d}" for s in map(int, scores)]
    return [max(-_LONG - 1, min(_LONG, int(s))) for s in scores], high


def from_columns(score: int, high: str | None) -> int:
    return score if high is None else int(high[1:]) - (10**_DIGITS if high[0] == "-" else 0)


def as_double(value: int, power: int) -> float:
    """value * 2^power, also of whole numbers that no double holds."""
    cut = max(0, value.bit_length() - 60)
    return math.ldexp(float(value >> cut), cut + power)


def exponent(x: np.ndarray) -> int:
    """The power of two that brings the greatest magnitude to at most 1."""
    return -int(np.frexp(np.abs(x).max(initial=0.0))[1]) if x.any() else 0


def best_first() -> tuple[Column, ...]:
    """The order of scores: those beyond 64 bits by their text."""
    return F.desc("score"), F.desc_nulls_last("high"), F.asc("vec_id")


def matrix(table: pa.Table) -> np.ndarray:
    """Column x of a table whose vectors are equally long (column _dims)."""
    return table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, table.column("_dims")[0].as_py())


def block_counts(candidates: DataFrame, queries: DataFrame, block: int | None = None, group: int | None = None) -> tuple[int, int]:
    """How many blocks and groups: candidates are copied once for each group, queries once for each block, so both are large, but enough for all cores."""
    n = candidates.count()
    size = block or max(LEAST_BLOCK, min(BLOCK, -(-n // (2 * cores(candidates.sparkSession)))))
    return max(1, -(-n // size)), max(1, -(-queries.count() // (group or GROUP)))


def in_blocks(candidates: DataFrame, queries: DataFrame, counts: tuple[int, int], search, schema: str, blocks: range | None = None) -> DataFrame:
    """search(block of candidates, group of queries) for every block (or those named) and every group; both are of one length of vectors (column _dims)."""
    n_blocks, n_groups = counts
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    used = blocks if blocks is not None else range(n_blocks)
    left = candidates.withColumn("_dims", F.size("x")).withColumn("_block", part(n_blocks)).where(F.col("_block").between(used[0], used[-1])).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    # fresh columns, as both sides may come from one table
    right = queries.select(*[F.col(c).alias(c) for c in queries.columns]).withColumn("_dims", F.size("x")).withColumn("_block", F.explode(F.sequence(F.lit(used[0]), F.lit(used[-1])))).withColumn("_group", part(n_groups))
    keys = ("_dims", "_block", "_group")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)


class Block:
    """Vectors with a sorted list for each component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[order], quantised(x[order])
        self.power = exponent(self.exact)
        scaled = self.exact * 2.0**self.power  # at most 1, and exact but for what is too small to matter
        self.rising = np.argsort(scaled, axis=0, kind="stable").T.copy()  # a list for each component
        self.sorted = np.take_along_axis(scaled, self.rising.T, 0).T.copy()

    def top(self, query_id: int, q: np.ndarray, k: int, bound: int | None = None, few: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids other than the query's, and their scores (whole numbers); fewer in a small block, or where other scores are below the bound.  q is quantised."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        own = exponent(q)
        w = q[used] * 2.0**own
        up = w > 0
        # a list's worst entry stands at the end that is read last
        worst = w * np.where(up, self.sorted[used, 0], self.sorted[used, -1]) if n else w
        rounding = 1e-9 * float(np.abs(w).sum()) + 1e-300  # components are at most 1, so this is far more than what sums lose
        gained = np.zeros(n)
        unread = np.ones((len(used), n), np.float32)
        alive, others = np.arange(n), self.ids != query_id
        floor = -np.inf if bound is None else as_double(bound, self.power + own) / SCALE**2 - float(worst.sum()) - rounding
        depth, step = 0, max(64, n // 5)
        while depth < n and len(alive) > max(few, k) and len(used):
            upto = min(n, depth + step)
            frontier = np.empty(len(used))
            for j, d in enumerate(used):
                part = slice(n - upto, n - depth) if up[j] else slice(depth, upto)
                rows, values = self.rising[d, part], self.sorted[d, part] * w[j]
                gained[rows] += values - worst[j]
                unread[j][rows] = 0
                frontier[j] = values[0] if up[j] else values[-1]
            depth = upto
            gap = frontier - worst
            # single precision, and so much more than its error
            room = gap.astype(np.float32) @ unread + (1e-4 * gap.sum() + rounding)
            mine = gained[others]
            least = np.partition(mine, len(mine) - k)[len(mine) - k] - rounding if len(mine) >= k else -np.inf
            alive = np.flatnonzero((gained + room >= max(least, floor)) & others)
        alive = alive[others[alive]]
        scores = exact_scores(self.exact[alive], q)
        best = sorted(range(len(alive)), key=lambda j: (-int(scores[j]), self.ids[alive[j]]))[:k]
        return self.ids[alive][best], scores[best]


def seeded(candidates: DataFrame, queries: DataFrame, counts: tuple[int, int], search, schema: str, k: int) -> DataFrame:
    """The k best of every query (query_id, vec_id, score, high as `search` has them, and rank): the first block, then the others with its k-th score as bound (column least)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first()))
    top = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    first = in_blocks(candidates, queries.withColumn("least", F.lit(None).cast("struct<score:bigint,high:string>")), counts, search, schema, range(1))
    if counts[0] == 1:
        return top(first)
    first = saved(top(first), "first-block")
    bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.struct("score", "high").alias("least"))
    rest = in_blocks(candidates, queries.join(bound, "vec_id", "left"), counts, search, schema, range(1, counts[0]))
    return top(first.drop("rank").unionByName(rest))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int | None = None, group: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for each query (both tables: vec_id, x as from `taking_part`)."""

    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": [], "high": []}
        if mine.num_rows and asked.num_rows:
            here = Block(mine.column("vec_id").to_numpy(), matrix(mine))
            for query_id, q, least in zip(asked.column("vec_id").to_pylist(), quantised(matrix(asked)), asked.column("least").to_pylist(), strict=True):
                ids, scores = here.top(query_id, q, k, from_columns(**least) if least else None)
                found["query_id"] += [query_id] * len(ids)
                found["vec_id"] += ids.tolist()
                for c, v in zip(("score", "high"), as_columns(scores), strict=True):
                    found[c] += v
        return pa.table({c: pa.array(v, pa.string() if c == "high" else pa.int64()) for c, v in found.items()})

    counts = block_counts(candidates, queries, block, group)
    return seeded(candidates.select("vec_id", "x"), queries.select("vec_id", "x"), counts, search, "query_id long, vec_id long, score long, high string", k).select("query_id", "rank", "vec_id", "score")


def searched(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Top k of all vectors for those whose id is divisible by `every`."""
    ready = saved(taking_part(vectors), "vectors")
    return top_k(ready, ready.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x")), k)
