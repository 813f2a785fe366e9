"""Hashed word shingles of whole texts, with Arrow and numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # the splitmix64 finaliser's constants
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def bounded(batch: pa.RecordBatch, text: str, rows: int, size: int = 16 << 20):
    """The batch in slices of at most so many rows and, unless one row is longer, bytes of text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        n = int(np.searchsorted(upto[at : at + rows], before + size, side="right"))
        yield batch.slice(at, max(1, n))
        at += max(1, n)


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, one text after the other, and how many each has.  A-Z only is lower-cased."""
    texts = pc.fill_null(texts, "")
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    per_text = np.diff(cut.offsets.to_numpy())
    words = cut.values[cut.offsets[0].as_py() : cut.offsets[-1].as_py()]
    full = pc.not_equal(words, "")
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(per_text)
    return words.filter(full).dictionary_encode(), (upto[ends] - upto[ends - per_text]).astype(np.int64)


def word_hashes(words: pa.DictionaryArray) -> np.ndarray:
    """A 64-bit hash of each word."""
    names = words.dictionary.to_pandas().to_numpy(dtype=object)
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.empty(0, np.uint64)
    return hashes[words.indices.to_numpy()]


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `width` words as sorted 64-bit hashes; a shorter text is one shingle; one without words has none."""
    words, counts = words_of(texts)
    hashes = word_hashes(words)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = mix(rolled * _STEP + hashes[k : len(hashes) - width + 1 + k] + _STEP)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            one = np.zeros(1, np.uint64)
            for h in hashes[at : at + n]:
                one = mix(one * _STEP + h + _STEP)
            out.append(mix(one + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out
