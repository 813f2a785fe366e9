"""Near duplicates (2) against all pairs of full shingle sets."""

import itertools
import random
import re
from collections import Counter

import pytest
import xxhash

from turnmill.llm import minhash


def brute(rows, width, percent):
    ids, sets = [], []
    for r in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids.append(r[0])
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(ids)), 2):
        i = len(sets[a] & sets[b])
        if i and None not in (ids[a], ids[b]) and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(ids[a]), find(ids[b])
            root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i), i == find(i)) for i, s in zip(ids, sets)), key=str)


@pytest.mark.parametrize(("width", "percent", "long_list"), [(3, 85, 24), (5, 80, 4)])
def test_against_all_pairs(docs, rows, width, percent, long_list):
    found = minhash.near_duplicates(docs, width=width, percent=percent, long_list=long_list)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, width, percent)


def groups(rows, width, percent):
    """What `one_of_each` keeps of rows: rows without id or words, and one text of each group of linked texts."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    signed = lambda t: -1 if t is None else (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - 2**64 * (h >= 2**63)
    part = [k for k, r in enumerate(rows) if r[0] is not None and sets[k]]
    root = {k: k for k in part}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(part, 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            root[find(a)] = find(b)
    first = {}
    for k in part:
        key = (rows[k][0], signed(rows[k][1]), rows[k][1])
        first[find(k)] = min(first.get(find(k), key), key)
    return Counter((i, t) for i, _, t in first.values()) + Counter((r[0], r[1]) for k, r in enumerate(rows) if k not in root)


def _repeated_ids():
    """Rows of one id with different texts of over 64 shingles, and a near copy of each; links through the id; an empty row of a known id."""
    rng = random.Random(12)
    a, b, c = ([f"{x}{rng.randrange(10**6)}" for _ in range(150)] for x in "abc")
    text = lambda w, k=None: " ".join(w if k is None else [*w[:k], "changed", *w[k + 1 :]])
    return [(70, text(a)), (70, text(b)), (71, text(a, 5)), (69, text(b, 9)), (70, ""), (60, text(c)), (72, text(c, 100)), (72, text(a, 80)), (72, text(a, 80)), (None, text(a)), (80, None)]


@pytest.mark.parametrize("width", [3, 5])
def test_texts_of_one_id_keep_their_links(spark, width):
    rows = _repeated_ids()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, minhash.near_duplicates(table, width=width, percent=80).collect()), key=str) == brute(rows, width, 80)
    assert Counter(map(tuple, minhash.one_of_each(table, width=width, percent=80).collect())) == groups(rows, width, 80)


def test_empty_table(empty):
    assert minhash.near_duplicates(empty).count() == 0 == minhash.one_of_each(empty).count()


def test_least_shared_is_a_safe_bound():
    assert 1 <= minhash.least_shared(64, 80) < minhash.least_shared(64, 85) < 64 * 0.85
