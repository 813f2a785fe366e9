"""Parity-sketch join (11) against all pairs of full shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from turnmill.llm import parity
from turnmill.llm.shingles import bounded

from .test_duplicates import _repeated_ids, brute


def _without_kept(found):
    return [r[:3] for r in found]


@pytest.mark.parametrize(("width", "percent", "long_list", "few"), [(4, 85, 24, 64), (4, 85, 3, 1), (5, 80, 4, 64), (2, 60, 24, 0)])
def test_against_all_pairs(docs, rows, width, percent, long_list, few):
    found = parity.joined(docs, width=width, percent=percent, long_list=long_list, few=few)
    assert sorted(map(tuple, found.collect()), key=str) == _without_kept(brute(rows, width, percent))


def test_chains_across_sizes(spark):
    """Texts that grow word by word and change place by place: links at and beside the threshold, over the edges of bands."""
    rng = random.Random(3)
    rows = []
    for n in (4, 5, 6, 7, 8, 9, 12, 14, 20, 33, 60, 110, 300):
        base = [f"x{rng.randrange(10**6)}" for _ in range(n)]
        for more in (0, 1, 2, n // 12, n // 9, n // 7, n // 6):
            rows.append((len(rows), " ".join([*base, *(f"y{rng.randrange(10**6)}" for _ in range(more))])))
            changed = list(base)
            for _ in range(more // 4):
                changed[rng.randrange(n)] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent in (85, 70):
        assert sorted(map(tuple, parity.joined(table, 4, percent).collect()), key=str) == _without_kept(brute(rows, 4, percent))


def test_texts_of_one_id_keep_their_links(spark):
    rows = _repeated_ids()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, band int").repartition(4)
    assert sorted(map(tuple, parity.joined(table, 4, 80).collect()), key=str) == _without_kept(brute(rows, 4, 80))


def test_texts_that_share_a_passage(spark):
    """Many short texts around one passage, and a group of near copies of one of them: long lists with and without links."""
    rng = random.Random(9)
    words = lambda n, c: [f"{c}{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(40, "p")
    rows = [(k, " ".join(passage + words(rng.choice([3, 8, 12]), "q"))) for k in range(120)]
    base = passage + words(20, "r")
    for k in range(200, 280):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            text[rng.randrange(len(text))] = f"s{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for long_list, few in ((24, 64), (5, 2)):
        assert sorted(map(tuple, parity.joined(table, 4, 85, long_list, few).collect()), key=str) == _without_kept(brute(rows, 4, 85))


def test_empty_table(empty):
    assert parity.joined(empty).count() == 0


def test_hamming_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 20).astype(np.uint64)]))
        for parts in (1, 3, 40):
            x = parity.sketch(a, parts) ^ parity.sketch(b, parts)
            assert sum(int(v).bit_count() for v in x) <= len(np.setxor1d(a, b))


def test_bands_hold_linked_sizes_side_by_side():
    for percent in (50, 80, 85, 95):
        known = parity.bands(5000, percent)
        of = lambda n: next(k for k, (high, _) in enumerate(known) if n <= high)
        for n in range(1, 3000):
            if n * 100 // percent <= known[-1][0]:
                assert of(n * 100 // percent) - of(n) <= 1
        assert all(parts > parity.apart(2 * high, percent) for high, parts in known)
        assert all(parts > 2 * parity.apart(2 * high, percent) for high, parts in parity.bands(5000, percent, parity.SPARE_AGAIN))


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c" * 5, "d" * 5]})
    assert [b.num_rows for b in bounded(batch, "text", 4, 20)] == [2, 1, 3]
    assert [b.num_rows for b in bounded(batch.slice(1), "text", 2, 1000)] == [2, 2, 1]
