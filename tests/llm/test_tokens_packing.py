"""Wavelet token shards (1) and best-fit packing (9) against the tokenizers library."""

import random
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from turnmill.llm import packing, tokens, wavelet


def _ids(name, text):
    return np.array([*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def _first_fit(lengths):
    """Sequences that first-fit decreasing needs."""
    room = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, x in enumerate(room) if x >= n), None)
        if k is None:
            room.append(2048 - n)
        else:
            room[k] -= n
    return len(room)


def test_wavelet_matrix_against_lists():
    rng = random.Random(1)
    for n, top in ((0, 5), (1, 1), (513, 7), (5000, 60_000)):
        ids = [rng.randrange(top) for _ in range(n)]
        m = wavelet.WaveletMatrix.of(np.array(ids, np.uint32))
        assert m.decode().tolist() == ids
        for symbol in {*ids[:3], 3, 70_000}:
            places = [i for i, x in enumerate(ids) if x == symbol]
            assert m.occurrences(symbol) == places
            assert m.count(symbol, n // 3, n) == sum(i >= n // 3 for i in places)
            assert m.rank(symbol, n // 2) == sum(i < n // 2 for i in places)
        assert [m.access(i) for i in range(0, n, 97)] == ids[::97]


def test_payload_round_trip():
    ids = np.array([4, 0, 9, 9, 0], np.uint16)
    doc, known, sizes, matrix = wavelet.from_payload(wavelet.to_payload(np.array([7, 0]), np.array([True, False]), np.array([2, 3]), ids))
    assert doc.tolist() == [7, 0] and known.tolist() == [True, False] and sizes.tolist() == [2, 3] and matrix.decode().tolist() == ids.tolist()


def test_shards_against_the_library(spark, docs, rows, empty):
    path = tempfile.mkdtemp(prefix="spark-") + "/shards"
    wavelet.write_shards(docs, path, public_tokenizers.path("byte_bpe_50k.json"), block_tokens=4096)
    found = sorted(wavelet.documents_from_shards(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    by_id = {r[0]: _ids("byte_bpe_50k.json", r[1]) for r in rows}
    start = 0
    for r in found:
        ids = by_id[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    wavelet.write_shards(empty, path + "0", public_tokenizers.path("byte_bpe_50k.json"))
    assert wavelet.documents_from_shards(spark, path + "0").count() == 0


def test_packing_against_the_library(docs, rows, empty):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack(packing.pieces(docs, tokenizer)).collect()
    by_id, sequences, pieces = {r[0]: _ids("word_bpe_49k.json", r[1]) for r in rows}, defaultdict(list), defaultdict(list)
    for r in found:
        ids = by_id[r["doc_id"]][r["piece"] * 2048 : (r["piece"] + 1) * 2048]
        assert (r["start"], r["length"], r["ids"]) == (r["piece"] * 2048, len(ids), ids.tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r["piece"])
    for r in {r[0] for r in rows}:
        times = sum(x[0] == r for x in rows)
        assert sorted(pieces[r]) == sorted([*range(-(-len(by_id[r]) // 2048))] * times)
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    assert len(sequences) <= _first_fit([r["length"] for r in found])
    assert packing.pack(packing.pieces(empty, tokenizer)).count() == 0


def _best_fit(lengths):
    """Sequences that best-fit decreasing needs."""
    room = []
    for n in sorted(lengths, reverse=True):
        space, k = min(((x, k) for k, x in enumerate(room) if x >= n), default=(None, None))
        if k is None:
            room.append(2048 - n)
        else:
            room[k] = space - n
    return len(room)


def _histograms():
    rng = np.random.default_rng(2)
    yield np.unique(rng.integers(1, 2049, 300)), 50
    yield np.unique(rng.integers(700, 1400, 120)), 9
    yield np.unique(rng.lognormal(5.5, 1, 1500).astype(int).clip(1, 2048)), 5
    yield np.array([683, 684, 600, 300, 2048, 1025]), 70
    yield np.array([2048]), 3
    yield np.array([1]), 5000


@pytest.mark.parametrize("k", range(6))
def test_solve_places_every_piece_once_and_is_no_worse_than_heuristics(k):
    lengths, most = [*_histograms()][k]
    counts = np.random.default_rng(k).integers(1, most + 1, len(lengths))
    placed, used = np.zeros(2049, int), 0
    for pattern, many in packing.solve(lengths, counts):
        assert sum(pattern) <= 2048
        np.add.at(placed, list(pattern), many)
        used += many
    assert (placed[lengths] == counts).all()
    every = np.repeat(lengths, counts).tolist()
    assert _first_fit(every) == sum(n for _, n in packing.first_fit(lengths, counts, 2048))
    assert packing.fractional(lengths, counts, 2048, 40, 0.5)[1] - 1e-6 <= used <= min(_first_fit(every), _best_fit(every))


def _odd_texts(n):
    rng = random.Random(11)
    words = ["the", "Cat", "DENİZLİ", "İ", "naïve", "o\u0308", "\u0301a", "ﬁn", "Ωmega", "straße", "日本", "ру", "don't", "I'LL", "42", "x_1", "🙂", "\u0345", "ǅ", "K", "\u00aa\u00ba"]
    marks = [",", ".", "!?", "...", ";", ":", "", "", "", "'s", "-", "\u0327", "\u0307,"]
    between = [" ", " ", " ", " ", "  ", "\t", "\n", " \n", "\u0085", "\u00a0", "\u2003", "\x1c", "\x0b", "", "\r\n"]
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "|>"]
    return ["".join(rng.choice(special if rng.random() < 0.05 else words) + rng.choice(marks) + rng.choice(between) for _ in range(rng.randrange(8))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    path, texts = public_tokenizers.path(name), _odd_texts(10_000)
    ids, counts = tokens.Encoder(path, max_words=2000).encode(pa.array([*texts, None], pa.string()))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    wanted = Tokenizer.from_file(path).encode_batch([*texts, ""], add_special_tokens=False)
    for text, mine, theirs in zip([*texts, None], parts, wanted, strict=True):
        assert mine.tolist() == theirs.ids, repr(text)
