"""Whitening and hard negatives against plain loops over Python's integers."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from turnmill.llm import negatives, topk, whitening


def _vectors(rng, n, dims, spread=1.0):
    return [[rng.gauss(0.2, spread) * (1 + d) / dims for d in range(dims)] for _ in range(n)]


def _plain(rows, components=4):
    """vec_id, component -> n, deviation, whitened, explained with exact means and deviations."""
    x = [(i, [max(-(2**63), min(2**63 - 1, math.floor(256 * Fraction(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in x})
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dims)]
    centred = lambda v: np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)])
    c = np.array([centred(v) for v in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    out = defaultdict(list)
    for i, v in x:
        deviation = min(2**63 - 1, sum((n * a - s) ** 2 for a, s in zip(v, sums)))
        for k in range(min(components, dims)):
            e = values[-1 - k]
            out[i, k + 1].append((n, deviation, float(centred(v) @ vectors[:, -1 - k] / math.sqrt(e)), e / values.sum()))
    return out


@pytest.mark.parametrize("dims,factor", [(6, 1.0), (3, 1.0), (5, 1e9)])
def test_whitening(spark, dims, factor):
    rng = random.Random(dims)
    rows = [(k, [c * factor for c in v]) for k, v in enumerate(_vectors(rng, 300, dims))]
    rows += [(k, rows[3][1]) for k in range(400, 460)] + [rows[5], rows[5], (None, rows[7][1]), (900, None), (901, [float("nan")] * dims), (902, [None] * dims), (903, [float("inf")] * dims)]
    table = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "vec_id long, embedding array<double>, component int, x string, whitened double").repartition(4)
    wanted, found = _plain(rows), defaultdict(list)
    for r in whitening.whitened(table).collect():
        found[r["vec_id"], r["component"]].append((r["n"], r["deviation"], r["whitened"], r["explained"]))
        assert r["identity_error"] < 1e-9
    assert found.keys() == wanted.keys()
    sign = {}
    for key, each in wanted.items():
        assert len(found[key]) == len(each)
        for (n, deviation, z, share), (n2, deviation2, z2, share2) in zip(sorted(found[key]), sorted(each), strict=True):
            assert (n, deviation) == (n2, deviation2)
            assert share == pytest.approx(share2, rel=1e-9)
            s = sign.setdefault(key[1], 1 if (z > 0) == (z2 > 0) else -1)
            assert z == pytest.approx(s * z2, abs=1e-7)


def test_whitening_of_what_has_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, []), (4, None)], schema)).count() == 0
    # two vectors span one direction; vectors of another length are whitened among themselves
    rows = [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [5.0]), (4, [7.0]), (5, [1e38])]
    found = sorted((r["vec_id"], r["component"], r["n"]) for r in whitening.whitened(spark.createDataFrame(rows, schema)).collect())
    assert found == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (4, 1, 3), (5, 1, 3)]


def _mined(rows, factor=256):
    """The contract's rows by plain loops over Python's integers."""
    of, out = [], []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            of.append((i, [math.floor(Fraction(c) * factor) for c in v], (label + 1) % 10 if i % 7 == 0 else label))
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    anchors = {}
    for i, x, label in of:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (x, label)), (x, label))
    for i, (q, label) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j, other == label) for j, x, other in of if j != i and len(x) == len(q))
        for p, j, _ in [s for s in scored if s[2]][:5]:
            within = [(s, n) for s, n, same in scored if not same and -30 * p <= -100 * s <= -90 * p][:10]
            out += [(i, j, r + 1, n, clamp(-p), clamp(-s)) for r, (s, n) in enumerate(within)]
    return sorted(out)


def test_hard_negatives(spark):
    rng = random.Random(13)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    labels = [rng.randrange(10) for _ in range(600)]
    rows = [(k, [c + rng.gauss(0, 0.7) for c in centres[label]], label) for k, label in enumerate(labels)]
    rows += [(1000 + k, rows[11][1], 3) for k in range(30)] + [(2001, rows[200][1], rows[200][2])] * 12 + [rows[300], rows[45], (100, rows[9][1], 4)]  # ties, repeated rows and anchors
    rows += [(3000, None, 1), (3100, rows[1][1], None), (3200, [float("nan")] * 8, 2), (3300, [None] * 8, 2), (3400, [], 2), (3500, [0.0] * 8, 5), (None, rows[2][1], 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, score string, rank int").repartition(3)
    floats = [(i, None if v is None else [c if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows]
    wanted = _mined(floats)
    assert len(wanted) > 100
    for block, group in ((None, None), (64, 2), (900, 1)):
        assert sorted(map(tuple, negatives.mined(table, block=block, group=group).collect())) == wanted
    assert negatives.mined(table.limit(0)).count() == 0


def test_hard_negatives_of_any_finite_components(spark):
    rng = random.Random(4)
    great = lambda: rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e6), rng.choice([-1, 1]) * rng.random() * 2.0**rng.randrange(60)])
    rows = [(k, [great() for _ in range(3)], rng.randrange(3)) for k in range(350)] + [(1000 + k, [rng.gauss(0, 1) for _ in range(2)], k % 2) for k in range(101)]
    rows += [(3000, [1e300, -1e308], 1), (3001, [1.6e308, 1.0], 1), (3002, [1e308, 2.0], 2), (3003, [9e307, 5e307], 0), (3004, [0.0, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, negatives.mined(table, block=90, group=2).collect())) == _mined(rows)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 5)), np.zeros((5, 5)), rng.normal(size=(3, 5)) * 1e6])
    here = negatives.Approximation(np.arange(len(x)), np.zeros(len(x)), x, cells=8)
    q = topk.quantised(rng.normal(size=5), 256)
    low, high, power, slack = here.bounds(q, np.arange(len(x)))
    exact = here.scores(q, np.arange(len(x))).astype(float) / 256**2 * 2.0**power
    assert (low - slack <= exact).all() and (exact <= high + slack).all()
    assert (high - low).min() > 0 or len(np.unique(x, axis=0)) < 208
