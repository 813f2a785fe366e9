"""Source mixing (7), telephony audio (8) and exact top-k (10) against plain loops."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from turnmill.llm import audio, mixing, queries, topk
from turnmill.llm.common import shared_dir


def _targets(sizes, weights=(5, 2, 1), most=3):
    """Reshares the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        rest, w = total - sum(most * sizes[s] for s in full), sum(weight[s] for s in free)
        out = {s: float(most * sizes[s]) if s in full else rest * weight[s] / w for s in order}
        more = {s for s in free if out[s] > most * sizes[s]}
        if not more:
            return out
        full |= more


def test_mixing(docs, rows, empty):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    found = mixing.mixed(docs).collect()
    assert len(found) == len(rows)
    goal = _targets(sizes)
    source_of = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in found:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s]) and 0 <= r["copies"] <= 3
        taken[s] += r["size"] * r["copies"]
    assert all(abs(taken[s] - goal[s]) <= 0.1 * goal[s] + 20_000 * (s == source_of[144]) for s in goal)
    assert sorted(map(tuple, mixing.mixed(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, found), key=str)
    assert Counter(r["doc_id"] for r in mixing.emitted(docs).collect()) == Counter({k: v for k, v in sum((Counter({r["doc_id"]: r["copies"]}) for r in found), Counter()).items() if v})
    assert mixing.emitted(docs).columns == docs.columns and mixing.mixed(empty).count() == 0 == mixing.emitted(empty).count()


def test_targets_of_many_sources(spark):
    rng = random.Random(6)
    sizes = {f"s{k}": rng.choice([0, 1, 10, 1000, 10**6]) for k in range(50)} | {None: 77}
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    goal = _targets(sizes)
    assert all(r["target"] == pytest.approx(goal[r["source"]]) for r in found) and len(found) == len(sizes)


def test_law_tables():
    mu, a = audio.mulaw_table().tolist(), audio.alaw_table().tolist()
    assert [mu[k] for k in (0xFF, 0x7F, 0x80, 0x00)] == [0, 0, 32124, -32124]
    assert [a[k] for k in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]


def test_adpcm_against_one_block_at_a_time():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5 * 64, np.uint8)
    data.reshape(5, 64)[:, 2] %= 89
    out = []
    for block in data.reshape(5, 64):
        value, index = int(block[:2].view("<i2")[0]), int(block[2])
        out.append(value)
        for code in (c for b in block[4:].tolist() for c in (b & 15, b >> 4)):
            step = audio.STEPS[index]
            size = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            index = max(0, min(88, index + audio.CHANGES[code & 7]))
            out.append(value)
    file = audio.wav(data.tobytes(), audio.IMA, bits=4, block=64)
    assert audio.decode(file)[0].tolist() == out


def test_resampling_in_parts():
    x = (8000 * np.sin(np.arange(5000) / 9)).astype(np.int16)
    for up, down in ((2, 1), (1, 2), (3, 2), (1, 4)):
        whole = audio.resample(x, up, down)
        assert len(whole) == math.ceil(len(x) * up / down) and (audio.resample(x, up, down, at_once=333) == whole).all()
    assert np.abs(audio.resample(x, 2, 1)[::2][50:-50].astype(int) - x[50:-50]).max() < 40


@pytest.mark.parametrize("kinds", [(audio.MULAW,), (audio.ALAW,), (audio.IMA,), (audio.MULAW, audio.ALAW, audio.IMA)])
def test_audio_round_trip(docs, rows, empty, kinds):
    found = audio.decoded(audio.store(docs, kinds)).collect()
    assert len(found) == len(rows)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    for r in found:
        raw = text[r["doc_id"]]
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        kind = kinds[zlib.crc32(payload) % len(kinds)]
        media = audio.coded(payload, kind)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert audio.parse(media)[0] == kind and audio.payload_of(media) == payload
        samples = audio.decode(media)[0]
        assert len(samples) == len(payload) * (129 / 64 if kind == audio.IMA else 1)
        assert (audio.unpacked_pcm(r["pcm_low"], r["pcm_high"]) == audio.resample(samples, audio.UP, audio.DOWN)).all()
    assert audio.decoded(audio.store(empty)).count() == 0


def test_pcm_is_stored_as_samples():
    """Two bytes a sample, and samples that the payload's codes don't hold: none can be read off the stored file."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 64, 5000):
        for pcm in (rng.integers(-32768, 32768, n).astype(np.int16), audio.resample(audio.mulaw_table()[rng.integers(0, 256, 4 * n)], audio.UP, audio.DOWN)):
            low, high = audio.packed_pcm(pcm)
            assert len(low) == len(high) == n and (audio.unpacked_pcm(low, high) == pcm).all()
    assert len(np.setdiff1d(pcm, audio.mulaw_table())) > 2000


def test_resampling_is_the_plain_sum():
    x = np.random.default_rng(5).integers(-32768, 32768, 300).astype(np.int16).tolist()
    for up, down in ((2, 1), (3, 2), (1, 2), (3, 4), (1, 4), (441, 320)):
        taps = audio.taps_for(up, down)
        bank, out = audio._filter(up, down, taps), []
        for k in range(0, len(x) * up, down):
            i, p = divmod(k, up)
            i -= taps // 2 - 1
            total = sum(int(bank[t, p]) * x[i + t] for t in range(taps) if 0 <= i + t < len(x))
            out.append(max(-32768, min(32767, (total + (1 << 13)) >> 14)))
        assert audio.resample(np.array(x, np.int16), up, down).tolist() == out


def test_audio_query_stores_the_pcm(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    root = shared_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(glob.glob(f"{root}/turnmill-pcm-*"))
    found = queries.op8_telephony_audio(spark, str(tmp_path)).collect()
    (path,) = set(glob.glob(f"{root}/turnmill-pcm-*")) - before
    stored = Counter((r["doc_id"], audio.unpacked_pcm(r["pcm_low"], r["pcm_high"]).tobytes()) for r in spark.read.parquet(f"file://{path}").collect())
    law = {audio.MULAW: audio.mulaw_table(), audio.ALAW: audio.alaw_table()}
    samples = lambda x, kind: law[kind][np.frombuffer(x, np.uint8)] if kind in law else audio.decode(audio.coded(x, kind))[0]
    payloads = [(r[0], raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")) for r in rows for raw in [(r[1] or "").encode()]]
    kinds = [audio.KINDS[zlib.crc32(x) % len(audio.KINDS)] for _, x in payloads]
    assert set(kinds) == {audio.MULAW, audio.ALAW, audio.IMA}
    pcm = [(k, audio.resample(samples(x, kind), 1, 4)) for (k, x), kind in zip(payloads, kinds, strict=True)]
    assert stored == Counter((k, x.astype("<i2").tobytes()) for k, x in pcm)
    wanted = Counter((k, audio.features(x, 2000), hashlib.sha256(x.astype("<i2").tobytes()).hexdigest()) for k, x in pcm)
    assert Counter((r["doc_id"], r["feature"], r["pcm_sha256"]) for r in found) == wanted


def test_other_formats_raise():
    with pytest.raises(ValueError):
        audio.parse(b"not a file")


def test_top_k(spark):
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(400)] + [(400, None), (500, [float("nan")] * 8), (600, [None] * 8), (700, [float("inf")] * 8), (800, []), (None, [1.0] * 8)]
    rows += [(1000 + k, rows[7][1]) for k in range(30)]  # ties
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    good = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    wanted = []
    for q in (i for i in good if i % 100 == 0):
        best = sorted(((-int(good[q] @ x), i) for i, x in good.items() if i != q))[:10]
        wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.searched(table).collect())) == sorted(wanted)
    vectors = topk.taking_part(table)
    blocked = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), block=64, group=2)
    assert sorted(map(tuple, blocked.collect())) == sorted(wanted)
    assert topk.searched(table.limit(0)).count() == 0


def test_top_k_of_any_finite_components(spark):
    """Against Python's integers: great and mixed components, repeated ids, unequal lengths, empty vectors."""
    rng = random.Random(3)
    great = lambda: rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e5), rng.gauss(0, 9e5), rng.choice([-1, 1]) * rng.random() * 2.0**rng.randrange(40)])
    rows = [(k, [great() for _ in range(64)]) for k in range(330)] + [(1000 + k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(101)] + [(2000, []), (2001, []), (2002, [])]
    rows += [(3000, [1e9] * 3), (3001, [1e9, 1e9, 1e9 + 1]), (3002, [-1e9] * 3), (3003, [1e300, -1e308, 1.0]), (3004, [1e9, 1e9, 1e9 + 2]), (3100, [0.0] * 3), (4000, [1.7e308] * 2), (4001, [1.6e308] * 2), (4002, [-1.6e308] * 2)]
    rows += [(7, rows[8][1]), (9, rows[9][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    of = [(i, [math.floor(Fraction(v) * 1024) for v in x]) for i, x in rows]
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    wanted = []
    for i, q in ((i, q) for i, q in of if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in of if j != i and len(x) == len(q))[:10]
        wanted += [(i, n + 1, j, clamp(-s)) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.searched(table).collect())) == sorted(wanted)
    vectors = topk.taking_part(table)
    assert sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), block=100, group=2).collect())) == sorted(wanted)


def test_top_k_counts_repeated_rows(spark):
    """Each candidate row counts, whole rows repeated 12 and 30 times too, within a block (one id) and across blocks (other ids of equal vectors)."""
    rng = random.Random(12)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(k, vector()) for k in range(90)]
    near = [v * 3 for v in rows[0][1]]
    rows += [(1001, near)] * 12 + [(1002, [v * 2 for v in rows[0][1]])] * 30 + [(2001 + k, near) for k in range(4)] * 2 + [(100, vector())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    of = [(i, [math.floor(Fraction(v) * 1024) for v in x]) for i, x in rows]
    wanted = []
    for i, q in ((i, q) for i, q in of if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in of if j != i)[:10]
        wanted += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    vectors = topk.taking_part(table)
    for block in (None, 20, 7):
        found = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), block=block, group=1)
        assert sorted(map(tuple, found.collect())) == sorted(wanted)
    duckdb = pytest.importorskip("duckdb")
    embeddings = table.toArrow()  # noqa: F841
    by_sql = duckdb.sql(queries.SQL["op10_top_k"]).fetchall()
    assert sorted(map(tuple, topk.searched(table).collect())) == sorted(by_sql)
