"""Embedding whitening by a two-pass covariance over the distinct vectors.

Entries become whole numbers floor(SCALE * c).  The fit list holds each distinct vector once and is
written to the shared folder.  A first pass over it adds up whole numbers, so the mean S / n is
exact; a second adds up outer products of centred vectors, each task's by one GEMM a batch;
treeAggregate merges the tasks' sums, a number of values that depends on the dimensions alone.
LAPACK's symmetric eigh gives the components, a third pass measures the covariance of what they
make of the fit list, and the projection is broadcast to all rows.

Left out: vectors that are null or hold a null or non-finite entry.  A null vec_id and repeated
rows are kept, each with its own result.  Vectors of each length are whitened among themselves.
Components without variance (eigenvalues at rounding level) have no whitened values: fewer
components are given, none where all vectors are equal, empty, or there is one.  Whole numbers
beyond 64 bits (entries, deviations) take the nearest long.  Of a component's two signs the one is
taken that makes its greatest entry positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SCALE, COMPONENTS = 256, 4
#: Entries of one batch's matrix.
ENTRIES_AT_ONCE = 1 << 20
_LONG = 2**63 - 1


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the whole-number entries, of the vectors that take part."""
    c = F.col("embedding").cast("array<double>")
    good = F.forall("c", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & good)
    return found.select("vec_id", F.transform("c", lambda v: F.floor(SCALE * v)).alias("x"))


def matrices(batch: pa.RecordBatch):
    """(rows, matrix) of the vectors in column x, those of one length together, a bounded number of entries at once."""
    x = batch.column("x")
    sizes = np.diff(x.offsets.to_numpy())
    flat, begins = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()[:-1]
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        step = max(1, ENTRIES_AT_ONCE // max(1, dims))
        for k in range(0, len(rows) if dims else 0, step):
            some = rows[k : k + step]
            yield some, flat[begins[some][:, None] + np.arange(dims)]


@dataclass
class Model:
    """n vectors whose sums are n * floor + rest by dimension; components as columns, with eigenvalues."""

    n: int
    floor: np.ndarray
    rest: np.ndarray
    components: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, as doubles: the whole part is taken off in whole numbers."""
        near = np.abs(x).max(initial=0) < 2**62 and np.abs(self.floor).max(initial=0) < 2**62
        apart = (x - self.floor).astype(np.float64) if near else x.astype(np.float64) - self.floor.astype(np.float64)
        return apart - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sums over dimensions of (n * x - S)^2, exact, as the nearest longs."""
        most = (float(np.abs(x).max(initial=0)) + float(np.abs(self.floor).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2.0**62:
            off = self.n * (x - self.floor) - self.rest
            return np.einsum("ij,ij->i", off, off).tolist()
        off = self.n * (x.astype(object) - self.floor.astype(object)) - self.rest.astype(object)
        return [min(_LONG, int(v)) for v in (off * off).sum(1)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))


def _merged(fit: DataFrame, schema: str, partial, add) -> dict:
    """What `partial` makes of each task's batches (dims and values), merged by dims through a tree."""

    def both(a: dict, b: dict) -> dict:
        for dims, value in b.items():
            a[dims] = add(a[dims], value) if dims in a else value
        return a

    rows = fit.mapInArrow(partial, schema).rdd
    return rows.treeAggregate({}, lambda a, r: both(a, {r["dims"]: tuple(r)[1:]}), both)


def means(fit: DataFrame) -> dict[int, Model]:
    """First pass: for every length of vectors their number and exact sums.  High and low halves are added apart, so no sum overflows."""

    def partial(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for _, x in matrices(batch):
                held = sums.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)])
                held[0] += len(x)
                held[1] += (x >> 32).sum(0)
                held[2] += (x & 0xFFFFFFFF).sum(0)
        for dims, (n, high, low) in sums.items():
            yield pa.RecordBatch.from_pydict({"dims": [dims], "n": [n], "high": [high.tolist()], "low": [low.tolist()]})

    # Python's integers from here on
    add = lambda a, b: (a[0] + b[0], [p + q for p, q in zip(a[1], b[1], strict=True)], [p + q for p, q in zip(a[2], b[2], strict=True)])
    out = {}
    for dims, (n, high, low) in _merged(fit, "dims long, n long, high array<long>, low array<long>", partial, add).items():
        parts = [divmod((h << 32) + s, n) for h, s in zip(high, low, strict=True)]
        out[dims] = Model(n, np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64))
    return out


def covariances(fit: DataFrame, models: dict[int, Model]) -> dict[int, np.ndarray]:
    """Second pass: sums of outer products of centred vectors, by n."""
    given = fit.sparkSession.sparkContext.broadcast(models)

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch):
                c = given.value[x.shape[1]].centred(x)
                sums[x.shape[1]] = sums.get(x.shape[1], 0.0) + c.T @ c
        for dims, total in sums.items():
            yield pa.RecordBatch.from_pydict({"dims": [dims], "products": [total.tobytes()]})

    add = lambda a, b: ((np.frombuffer(a[0]) + np.frombuffer(b[0])).tobytes(),)
    found = _merged(fit, "dims long, products binary", partial, add)
    return {dims: np.frombuffer(total).reshape(dims, dims) / models[dims].n for dims, (total,) in found.items()}


def decomposed(model: Model, covariance: np.ndarray, most: int) -> Model:
    """The model with its first components, by falling eigenvalue, as far as they have variance."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    trace = float(np.trace(covariance))
    order = order[values[order] > len(values) * np.finfo(float).eps * max(trace, 0.0)]
    w = vectors[:, order]
    if w.size:
        w = w * np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])])
    return Model(model.n, model.floor, model.rest, w, values[order], trace)


def identity_error(fit: DataFrame, models: dict[int, Model]) -> float:
    """Third pass: the largest absolute entry of the whitened fit list's covariance less the identity.

    Tasks' means and centred products are merged pairwise (Chan, Golub and LeVeque 1979).
    """
    given = fit.sparkSession.sparkContext.broadcast(models)

    def joined(a: tuple, b: tuple) -> tuple:
        (n, mean, m2), (k, other, o2) = a, b
        apart = np.subtract(other, mean)
        return n + k, (np.asarray(mean) + apart * k / (n + k)).tolist(), (np.asarray(m2) + o2 + np.outer(apart, apart).ravel() * (n * k / (n + k))).tolist()

    def partial(batches):
        sums: dict[int, tuple] = {}
        for batch in batches:
            for _, x in matrices(batch):
                z = given.value[x.shape[1]].whitened(x)
                mean = z.mean(0)
                now = (len(z), mean.tolist(), ((z - mean).T @ (z - mean)).ravel().tolist())
                sums[x.shape[1]] = joined(sums[x.shape[1]], now) if x.shape[1] in sums else now
        for dims, (n, mean, m2) in sums.items():
            yield pa.RecordBatch.from_pydict({"dims": [dims], "n": [n], "mean": pa.array([mean], pa.list_(pa.float64())), "m2": pa.array([m2], pa.list_(pa.float64()))})

    found = _merged(fit, "dims long, n long, mean array<double>, m2 array<double>", partial, joined)
    return max((float(np.abs(np.reshape(m2, (len(mean), len(mean))) / n - np.eye(len(mean))).max()) for n, mean, m2 in found.values() if mean), default=0.0)


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for every length of vectors in the fit list (column x: distinct vectors)."""
    models = means(fit)
    models = {dims: decomposed(models[dims], v, components) for dims, v in covariances(fit, models).items()}
    error = identity_error(fit, models)
    for model in models.values():
        model.identity_error = error
    return models


def projected(vectors: DataFrame, models: dict[int, Model]) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of vectors (vec_id, x) and component."""
    given = vectors.sparkSession.sparkContext.broadcast(models)

    def project(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for rows, x in matrices(batch):
                model = given.value[x.shape[1]]
                k = len(model.values)
                if not k:
                    continue
                each = np.repeat(np.arange(len(rows)), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(pa.array(rows[each])), "component": pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), "n": pa.array(np.full(len(each), model.n)), "deviation": pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                    "whitened": model.whitened(x).ravel(), "explained": np.tile(model.values / model.trace, len(rows)), "identity_error": np.full(len(each), model.identity_error),
                })

    return vectors.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """The first components of all vectors, whitened over the distinct ones."""
    ready = whole_vectors(vectors)
    fit = saved(ready.select("x").distinct(), "fit-list")
    return projected(ready, fitted(fit, components))
