"""Encoding of whole texts with a public tokenizer, at the speed of a word cache.

A byte-pair tokenizer first cuts a text into pieces and then encodes every piece alone,
so equal pieces have equal ids wherever they stand.  `Encoder` cuts texts at single
spaces (where both tokenizers used here also cut), finds the distinct words of a batch
with Arrow, cuts words it hasn't met into pieces, has the `tokenizers` library's model
encode new pieces, and gathers the ids of the texts with numpy.  Whatever this isn't proven for
goes to the library: texts in which a run of white space would be cut apart and texts that hold a
special token's string as wholes, words with letters beyond U+024F or rare white space as words.
So the ids are always those that the library, as loaded, gives for the whole text.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any kind next to a space that is followed by white space or by the end.
_UNSAFE = r"[\s\x0b\x1c-\x1f\x85\p{Z}] (?:[\s\x0b\x1c-\x1f\x85\p{Z}]|$)"
#: Letters up to U+024F, but for U+0130, whose lower case ends in a combining mark; and a word of them with marks after it.
_LETTERS = r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+"
_MARKED = rf"^{_LETTERS}[.,;:!?]+$"
#: Characters that the two libraries' patterns might class apart, and U+0130.
_ODD = frozenset("\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u0130")


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


#: The split of byte-level BPE, where the tokenizer's file names none.  A fixed value.
_BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter of each byte: printable ones stand for themselves, the rest for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts.  `max_words` bounds the memory of the word cache."""

    def __init__(self, path: str, max_words: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model, self.normalizer = self.library.model, self.library.normalizer
        with open(path, encoding="utf-8") as f:
            cut = json.load(f)["pre_tokenizer"]
        found = [x["pattern"]["Regex"] for x in cut.get("pretokenizers", []) if x["type"] == "Split"]
        self.spaced = not found  # a piece then holds the space before it
        self.split = regex.compile(found[0] if found else _BYTE_LEVEL_SPLIT).findall
        self.letters = _byte_letters()
        self.max_words = max_words
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.empty(1 << 20, np.uint16)
        self.begin = np.zeros(1 << 16, np.int64)  # of word n in the pool; word n+1 begins where it ends
        self.n = 0

    def _keep(self, words: list[str], flat: list[int], lengths: list[int]) -> None:
        used = int(self.begin[self.n])
        while used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.n + len(words) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.pool[used : used + len(flat)] = flat
        self.begin[self.n + 1 : self.n + 1 + len(words)] = used + np.cumsum(lengths)
        self.known.update(zip(words, range(self.n, self.n + len(words))))
        self.n += len(words)

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        flat, lengths, tokenize, normalize = [], [], self.model.tokenize, self.normalizer and self.normalizer.normalize_str
        for word in words:
            before = len(flat)
            if word.isascii():
                if normalize:
                    word = word.lower()
                bare = word[1:] if self.spaced and word[:1] == " " else word
                if bare.isalpha():  # one piece
                    flat += [t.id for t in tokenize("\u0120" + bare if bare is not word else word)]
                    lengths.append(len(flat) - before)
                    continue
                odd = not _ODD.isdisjoint(word)
            else:
                odd = max(word) > "\u024f" or not _ODD.isdisjoint(word)
                if normalize and not odd:
                    word = normalize(word)
            if odd:
                flat += self._whole(word)
                lengths.append(len(flat) - before)
                continue
            for piece in self.split(word):
                flat += [t.id for t in tokenize(piece.encode().decode("latin-1").translate(self.letters))]
            lengths.append(len(flat) - before)
        self._keep(words, flat, lengths)

    def _at(self, words: pa.Array, prefix: str = "") -> np.ndarray:
        """The numbers of the words with `prefix` before them."""
        words = words.to_pylist()
        if prefix:
            words = [prefix + w for w in words]
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = self.n + np.arange(len(missing))
            self._learn([words[k] for k in missing])
        return at

    def _halves(self, words: pa.Array, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of each word's letters and of the marks after them; a word of another kind is all in the first."""
        plain = pc.match_substring_regex(words, _MARKED)
        stems = pc.if_else(plain, pc.utf8_rtrim(words, ".,;:!?"), words).dictionary_encode()
        marks = pc.if_else(plain, pc.replace_substring_regex(words, f"^{_LETTERS}", ""), "").dictionary_encode()
        return (self._at(stems.dictionary, prefix)[stems.indices.to_numpy()], self._at(marks.dictionary)[marks.indices.to_numpy()])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has.  A null text is empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, np.uint16), np.empty(0, np.int64)
        whole = np.asarray(pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False), bool)
        for token in self.special:  # in any case: a tokenizer may look for them after lower-casing, and this search is the faster one
            whole |= np.asarray(pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False), bool)
        safe = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        cut = pc.split_pattern(safe, " ")
        per_text = np.diff(cut.offsets.to_numpy())
        coded = cut.values[cut.offsets[0].as_py() : cut.offsets[-1].as_py()].dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        if self.n + len(words) // 2 > self.max_words and self.n:
            self.forget()
        stem, mark = (x[index] for x in self._halves(words, " " if self.spaced else ""))
        if self.spaced:  # no space stands before a text's first word
            first = np.cumsum(per_text) - per_text
            opening = words.take(pa.array(index[first])).dictionary_encode()
            stem[first], mark[first] = (x[opening.indices.to_numpy()] for x in self._halves(opening.dictionary, ""))
        at = np.stack([stem, mark], 1).ravel()
        starts = self.begin[at]
        lengths = self.begin[at + 1] - starts
        ids = self.pool[runs(starts, lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = 2 * np.cumsum(per_text)
        counts = upto[ends] - upto[ends - 2 * per_text]
        if whole.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(whole):
                parts[k] = np.array(self._whole(texts[int(k)].as_py()), np.uint16)
            counts = np.array([len(p) for p in parts])
            ids = np.concatenate(parts)
        return ids, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
