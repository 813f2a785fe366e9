"""Hard negatives by a vector-approximation file (Weber, Schek and Blott 1998).

Vectors are dealt out in blocks by a hash of their id, anchors in groups; each block meets each
group.  A block quantises every dimension into cells that hold equally many vectors and keeps a
vector as its cells' numbers.  For an anchor a table holds the least and the greatest product with
its entry for each cell; looked up and added up, they bound every vector's score from below and
above.  The vectors themselves are scored only where their bounds let them enter a window.

Two passes.  The first finds an anchor's positives, its best rows of the same label: a window
that begins at the k-th best lower bound (and at the first block's k-th score).  The second finds
negatives for the windows that the positives' scores open: a row of another label is scored where
its bounds meet a window, unless as many rows surely within it have better lower bounds.

Components are whole numbers floor(SCALE * x), scores sums of whole numbers of any size, ranked by
their own value and given as the nearest long.  Bounds are doubles that leave room for rounding.

Left out: null ids, labels or vectors, null or non-finite components, and pairs of different
length.  Rows of the anchor's id are neither its positives nor its negatives; of repeated
anchor ids the least vector with its label asks.  Every other row counts for itself, also where
ids or whole rows repeat: a positive that repeats has its negatives as often.  Ties go to the
smaller id.  A positive with a negative score opens an empty window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import topk
from .common import saved

SCALE, CELLS, POSITIVES, NEGATIVES = 256, 64, 5, 10
#: The window's ends in hundredths of the positive's score.
FROM, TO = 30, 90


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, x, label (of ids divisible by 7 the next one) of the rows that take part."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return topk.taking_part(vectors.where("label is not null"), moved.alias("label"))


class Approximation:
    """Vectors as the numbers of their cells, and the vectors for exact scores."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, cells: int = CELLS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.exact = ids[order], labels[order], topk.quantised(x[order], SCALE)
        n, dims = self.exact.shape
        self.power = topk.exponent(self.exact)
        rank = np.argsort(self.exact, axis=0, kind="stable")
        rising = np.take_along_axis(self.exact, rank, 0) * 2.0**self.power
        cells = min(cells, n)
        begins = np.arange(cells) * n // cells
        # the ends of a cell are the least and the greatest of its entries
        self.least, self.greatest = rising[begins].T.copy(), rising[np.append(begins[1:], n) - 1].T.copy()
        self.places = np.empty((n, dims), np.intp)  # of a vector's cells in a flat table of dims x cells
        np.put_along_axis(self.places, rank, np.repeat(np.arange(cells), np.diff(np.append(begins, n)))[:, None], 0)
        self.places += np.arange(dims) * cells

    def bounds(self, q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float]:
        """Lower and upper bounds of the rows' scores in units of 2^-power, that power, and what rounding may move them by."""
        own = topk.exponent(q)
        w = (q * 2.0**own)[:, None]
        a, b = w * self.least, w * self.greatest
        places = self.places[rows]
        low, high = np.minimum(a, b).ravel()[places].sum(1), np.maximum(a, b).ravel()[places].sum(1)
        return low, high, self.power + own, 1e-9 * float(np.abs(w).sum()) + 1e-300

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return topk.exact_scores(self.exact[rows], q, SCALE)

    def first(self, rows: np.ndarray, scores, k: int) -> list[int]:
        """Places of the k best of the rows' scores, ties by id (rows rise with their ids)."""
        return sorted(range(len(rows)), key=lambda j: (-int(scores[j]), rows[j]))[:k]

    def best(self, q: np.ndarray, rows: np.ndarray, k: int, bound: int | None) -> tuple[np.ndarray, list[int]]:
        """The k rows of greatest score, those below the bound left out, and their scores."""
        if not len(rows):
            return rows, []
        low, high, power, slack = self.bounds(q, rows)
        least = np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf
        if bound is not None:
            least = max(least, topk.as_double(bound, power) / SCALE**2)
        rows = rows[high + 2 * slack >= least]
        scores = self.scores(q, rows)
        order = self.first(rows, scores, k)
        return rows[order], [int(scores[j]) for j in order]

    def windows(self, q: np.ndarray, rows: np.ndarray, positives: list[int], k: int) -> list[tuple[np.ndarray, list[int]]]:
        """For each positive's score the k rows of greatest score within its window, and their scores."""
        if not len(rows):
            return [(rows, [])] * len(positives)
        low, high, power, slack = self.bounds(q, rows)
        wanted = np.zeros(len(rows), bool)
        for p in positives:
            if p >= 0:
                begin, end = (topk.as_double(share * p, power) / (100 * SCALE**2) for share in (FROM, TO))
                room = 2 * slack + 1e-15 * abs(end)
                sure = low[(low >= begin + room) & (high <= end - room)]
                least = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
                wanted |= (high >= max(begin, least) - room) & (low <= end + room)
        rows = rows[wanted]
        scores = self.scores(q, rows)
        if len(scores) and max(abs(int(scores.max())), abs(int(scores.min()))) >= 2**55:
            scores = scores.astype(object)
        out = []
        for p in positives:
            # compared in hundredths, as Python's integers where 64 bits may not hold them
            within = np.flatnonzero(((FROM * p <= 100 * scores) & (100 * scores <= TO * p)).astype(bool)) if p >= 0 and TO * p < 2**62 or scores.dtype == object else np.flatnonzero([FROM * p <= 100 * int(s) <= TO * p for s in scores])
            some = rows[within]
            order = self.first(some, scores[within], k)
            out.append((some[order], [int(scores[within[j]]) for j in order]))
        return out


def _asked(mine: pa.Table, asked: pa.Table):
    """The block, and each anchor's row as a dict with its vector q."""
    if mine.num_rows and asked.num_rows:
        here = Approximation(mine.column("vec_id").to_numpy(), mine.column("label").to_numpy(), topk.matrix(mine))
        for row, q in zip(asked.drop_columns(["x"]).to_pylist(), topk.quantised(topk.matrix(asked), SCALE), strict=True):
            yield here, row, q


def _table(found: dict[str, list]) -> pa.Table:
    return pa.table({c: pa.array(v, pa.string() if c.endswith("high") else pa.int64()) for c, v in found.items()})


def positives(rows: DataFrame, anchors: DataFrame, counts: tuple[int, int], k: int = POSITIVES) -> DataFrame:
    """query_id, vec_id, score, high, rank: the k best rows of each anchor's label (both tables: vec_id, x, label)."""

    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "high": []}
        for here, row, q in _asked(mine, asked):
            same = np.flatnonzero((here.labels == row["label"]) & (here.ids != row["vec_id"]))
            places, scores = here.best(q, same, k, topk.from_columns(**row["least"]) if row["least"] else None)
            found["query_id"] += [row["vec_id"]] * len(places)
            found["vec_id"] += here.ids[places].tolist()
            for c, v in zip(("score", "high"), topk.as_columns(scores), strict=True):
                found[c] += v
        return _table(found)

    return topk.seeded(rows, anchors, counts, search, "query_id long, vec_id long, score long, high string", k)


def negatives(rows: DataFrame, anchors: DataFrame, found: DataFrame, counts: tuple[int, int], k: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the positives found."""
    held = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "high"))).alias("positives")).withColumnRenamed("query_id", "vec_id")

    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor_id": [], "nth": [], "positive_id": [], "positive_score": [], "vec_id": [], "score": [], "high": []}
        for here, row, q in _asked(mine, asked):
            other = np.flatnonzero((here.labels != row["label"]) & (here.ids != row["vec_id"]))
            opened = [topk.from_columns(p["score"], p["high"]) for p in row["positives"]]
            for p, (places, scores) in zip(row["positives"], here.windows(q, other, opened, k), strict=True):
                for c, v in (("anchor_id", row["vec_id"]), ("nth", p["rank"]), ("positive_id", p["vec_id"]), ("positive_score", p["score"])):
                    out[c] += [v] * len(places)
                out["vec_id"] += here.ids[places].tolist()
                for c, v in zip(("score", "high"), topk.as_columns(scores), strict=True):
                    out[c] += v
        return _table(out)

    schema = "anchor_id long, nth long, positive_id long, positive_score long, vec_id long, score long, high string"
    near = topk.in_blocks(rows, anchors.join(held, "vec_id"), counts, search, schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "nth").orderBy(*topk.best_first()))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(vectors: DataFrame, every: int = 100, block: int | None = None, group: int | None = None) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by `every`, among all rows."""
    ready = saved(taking_part(vectors), "labelled-vectors")
    anchors = ready.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("x", "label")).alias("least")).select("vec_id", "least.x", "least.label")
    counts = topk.block_counts(ready, anchors, block, group)
    found = saved(positives(ready, anchors, counts), "positives")
    return negatives(ready, anchors, found, counts)
