"""Importance resampling (3), toxicity (4) and stupid backoff (6)."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from turnmill.llm import backoff, resample, toxicity

SF = "/root/testdata/sf0.1"


def test_resampling_against_counting(spark, docs, rows):
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 0) for k in range(40)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    ratios, share = resample.log_ratios(docs, labels)
    assert share == 14 / 40
    raw, target = Counter(), Counter()
    for doc_id, text, *_ in rows:
        grams = resample.ngrams(pa.array([text], pa.string()))[0].ravel()
        of = Counter(grams[grams >= 0].tolist())
        raw.update(of)
        if doc_id is not None and doc_id < 40 and doc_id % 3 == 0 and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            target.update(of)
    chance = lambda c, b: (c[b] + 1) / (sum(c.values()) + resample.BUCKETS)
    some = [*list(raw)[:50], *list(target)[:50]]
    assert np.allclose(ratios[some], [math.log(chance(target, b) / chance(raw, b)) for b in some])
    found = resample.resampled(docs, labels).collect()
    wanted = round(len(rows) * share)
    best = sorted((r["key"] for r in found), reverse=True)[:wanted]
    assert all(r["kept"] == (r["key"] >= best[-1]) for r in found) and sum(r["kept"] for r in found) >= wanted
    assert {r["log_weight"] for r in found if r["doc_id"] is not None and not (rows[r["doc_id"]][1] or "").strip()} == {0.0}


def test_greatest_keys(spark):
    rng = random.Random(3)
    keys = [(k, rng.choice([0.5, rng.random()])) for k in range(3000)]
    table = spark.createDataFrame(keys, "doc_id long, key double")
    order = [k for k, _ in sorted(keys, key=lambda x: (-x[1], x[0]))]
    for k in (0, 1, 1500, 3000):
        assert {r["doc_id"] for r in resample.greatest(table, k, bins=8, few=10).where("kept").collect()} == set(order[:k])


def test_resampling_without_rows(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resample.resampled(docs, labels).where("not kept").count() == 0
    assert resample.resampled(empty, labels).count() == 0


def test_toxicity_held_out():
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), max(toxic) FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL GROUP BY 1, 2 ORDER BY 1").fetchall()
    held = np.array([zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows])
    texts, toxic = pa.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    model = toxicity.train(texts.filter(pa.array(~held)), toxic[~held])
    scores, truth = model.scores(texts.filter(pa.array(held))), toxic[held] == 1
    above = (scores[truth][:, None] > scores[~truth][None, :]).mean()
    assert above > 0.9
    found = (scores >= toxicity.THRESHOLD) & truth
    assert found.sum() > 0.5 * truth.sum() and found.sum() > 0.5 * (scores >= toxicity.THRESHOLD).sum()


def test_unseen_misspelling_and_edges():
    rng = random.Random(4)
    plain = [f"{a}{b}" for a in ("lam", "tor", "ben", "sil") for b in ("ade", "uke", "iro", "ona")]
    texts, toxic = [], []
    for k in range(400):
        toxic.append(k % 2)
        texts.append(" ".join([*rng.choices(plain, k=6), *(["scoundrel"] if k % 2 else [])]))
    model = toxicity.train(pa.array(texts), np.array(toxic))
    bad, good, null, blank = model.scores(pa.array(["lamade scoundrell toruke", "lamade benona toruke", None, ""], pa.string()))
    assert bad > 0.5 > good and null == blank
    one_class = toxicity.train(pa.array(["a", "b"]), np.array([0, 0]))
    assert one_class.scores(pa.array(["a"]))[0] < 1e-6


def test_scores_against_plain_bags():
    """One word and one n-gram at a time, from the trained table."""
    model = toxicity.train(pa.array(["good words here", "awful words there"] * 20), np.array([0, 1] * 20), epochs=2)

    def logit(text):
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w).lower().strip(toxicity._STRIPPED) for w in (text or "").split()]
        total = 0.0
        for w in words:
            rows = [int(toxicity.pd.util.hash_array(np.array([w], dtype=object), categorize=False)[0]) % toxicity.BUCKETS]
            marked = f"<{w}>"
            for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
                for k in range(len(marked) - n + 1):
                    rolled = 0
                    for c in marked[k : k + n]:
                        rolled = (rolled * int(toxicity._PRIME) + ord(c)) % 2**64 if rolled else ord(c)
                    rows.append(int(toxicity.mix(np.array([(rolled + n) % 2**64], np.uint64))[0]) % toxicity.BUCKETS)
            total += sum(float(model.table[r]) for r in rows) / len(rows)
        return model.bias + total / max(1, len(words))

    texts = ["good awful", "Awful, WORDS! (there)", "", None, "a", "  naïve café " * 30, "x" * 500, "... !!"]
    assert np.allclose(model.scores(pa.array(texts, pa.string())), [1 / (1 + math.exp(-logit(t))) for t in texts], atol=1e-6)


def test_toxicity_of_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(40)] + [(None, 0, 1), (3, 0, None), (2, 0, 0), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.scored(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert sorted(map(str, (tuple(r["row"]) for r in found))) == sorted(map(str, rows))
    assert toxicity.scored(empty, toxicity.fit(empty, labels)).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_against_counting(docs, rows, empty, order):
    split = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    counts = Counter()
    for r in rows:
        w = split(r[1])
        counts.update(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)

    def score(gram):
        if len(gram) == 1:
            return counts[gram] / total
        return counts[gram] / counts[gram[:-1]] if counts[gram] >= 2 else 0.4 * score(gram[1:])

    wanted = defaultdict(list)
    for r in rows:
        w = split(r[1])
        logs = sum(math.log(score(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w)))
        wanted[r[0]] = [len(w), logs, logs / len(w) if w else None]
    found = backoff.scores(docs, order, rows=50, bucket_words=2000).collect()
    assert len(found) == len(rows)
    for r in found:
        k, logs, mean = wanted[r["doc_id"]]
        assert r["n_words"] == k and r["log_score"] == pytest.approx(logs, abs=2e-4)
        assert r["mean_score"] is None if mean is None else r["mean_score"] == pytest.approx(mean, abs=1e-4)
    table = backoff.count_tables(docs, order, rows=50, bucket_words=2000).collect()
    assert len({(r["gram_order"], r["gram"]) for r in table}) == len(table)
    assert Counter((r["gram_order"], r["n"]) for r in table) == Counter((len(g), c) for g, c in counts.items())
    assert backoff.scores(empty, order).count() == 0 == backoff.count_tables(empty, order).count()


def test_blocks_keep_their_bounds(spark, docs, rows):
    """No block holds more rows or bytes of text than it may, but for one text that is longer; scores don't depend on the blocks."""
    size = lambda t: len((t or "").encode())
    for n, most in ((50, 1 << 20), (4096, 2000), (3, 500)):
        held = backoff.blocks(docs, n, most).collect()
        texts = {}
        for r in rows:
            texts.setdefault(r[0], []).append(r[1])
        assert sorted((i for b in held for i in b["doc_ids"]), key=str) == sorted((r[0] for r in rows), key=str)
        for b in held:
            assert len(b["doc_ids"]) <= n
            assert sum(size(texts[i][0]) for i in b["doc_ids"]) <= most or len(b["doc_ids"]) == 1
            assert b["n"] == sum(b["sizes"])
    long_ = spark.createDataFrame([(k, f"w{k % 7} " * 60_000) for k in range(12)], "doc_id long, text string").repartition(1)
    assert [len(b["doc_ids"]) for b in backoff.blocks(long_, 4096, 1 << 20).collect()] == [5, 5, 2]
    assert {(r["n_words"]) for r in backoff.scores(long_).collect()} == {60_000}
