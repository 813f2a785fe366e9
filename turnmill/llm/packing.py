"""Best-fit packing of token pieces by a configuration linear program.

`pieces` encodes whole texts and cuts those over the capacity.  `solve` packs a histogram of
lengths (at most `capacity` numbers, whatever the corpus): multiplicative weights price the
lengths, an unbounded-knapsack dynamic program finds the sequence of greatest price, whole
numbers of those sequences are taken, and best-fit decreasing places the rest (see `solve`).
`pack` gives every piece its place: the n-th piece of a length takes the plan's n-th place for
that length.

A null text is empty: it has the end id alone.  Repeated rows are packed each for itself.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_of
from .tokens import encoder, runs

CAPACITY, END_ID = 2048, 0
_PIECE = "doc_id long, piece int, start long, length long, part int, nth long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, rows_at_once: int = 4000) -> DataFrame:
    """The pieces of every document, written to the shared folder.

    ids are little-endian unsigned 32-bit integers; nth numbers the pieces of a length
    within the part of the input that one task has read.
    """

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, rows_at_once):
                rows = batch.slice(k, rows_at_once)
                ids, counts = encoder(tokenizer).encode(rows.column("text"))
                sizes = counts + 1
                whole = np.full(len(ids) + len(sizes), END_ID, np.uint32)
                whole[runs(np.cumsum(sizes) - sizes, counts)] = ids
                each = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), each)
                number = runs(np.zeros(len(each), np.int64), each)
                length = np.minimum(sizes[row] - number * capacity, capacity)
                order = np.argsort(length, kind="stable")
                here = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(here) - here, here) + np.repeat(seen, here)
                seen += here
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
                coded = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id").take(pa.array(row)), "piece": pa.array(number.astype(np.int32)), "start": pa.array(number * capacity), "length": pa.array(length), "part": pa.array(np.full(len(row), part, np.int32)), "nth": pa.array(nth), "ids": coded})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return saved(source.mapInArrow(cut, _PIECE), "pieces")


def best_sequence(lengths: np.ndarray, price: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length a sequence of greatest total price has: knapsack dynamic program over the fill."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    sorted_lengths, sorted_price = lengths[order], price[order]
    upto = np.searchsorted(sorted_lengths, np.arange(capacity + 1), side="right")
    for fill in range(1, capacity + 1):
        best[fill] = best[fill - 1]
        n = upto[fill]
        if n:
            worth = best[fill - sorted_lengths[:n]] + sorted_price[:n]
            k = int(worth.argmax())
            if worth[k] > best[fill]:
                best[fill], choice[fill] = worth[k], order[k]
    taken, fill = np.zeros(len(lengths), np.int64), capacity
    while fill > 0:
        k = choice[fill]
        if k < 0:
            fill -= 1
        elif taken[k] < left[k]:
            taken[k] += 1
            fill -= lengths[k]
        else:  # no more of this length: go on with what fits
            fits = np.flatnonzero((lengths <= fill) & (taken < left))
            if not len(fits):
                break
            k = fits[np.argmax(price[fits])]
            taken[k] += 1
            fill -= lengths[k]
    return taken


def fill_up(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths in a sequence, how many such sequences)."""
    room: dict[int, list[list]] = {}  # free space: groups of [pattern, how many]
    free: list[int] = []

    def put(pattern: tuple[int, ...], many: int, space: int) -> None:
        if many:
            if space not in room:
                room[space] = []
                bisect.insort(free, space)
            room[space].append([pattern, many])

    for k in np.argsort(-lengths):
        length, left = int(lengths[k]), int(counts[k])
        while left:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                space, pattern, many = capacity, (), left
            else:
                space = free[at]
                pattern, many = room[space].pop()
                if not room[space]:
                    del room[space], free[at]
            each = space // length
            full = min(many, left // each)
            put(pattern + (length,) * each, full, space - each * length)
            left, rest = left - full * each, many - full
            if left and rest:  # one sequence takes what is left
                put(pattern + (length,) * left, 1, space - left * length)
                left, rest = 0, rest - 1
            if pattern:
                put(pattern, rest, space)
    return [(pattern, many) for groups in room.values() for pattern, many in groups]


def first_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """First-fit decreasing over a histogram; like sequences that were begun one after the other are one group."""
    groups: list[tuple[tuple[int, ...], int]] = []
    spaces = np.empty(0, np.int64)
    for k in np.argsort(-lengths):
        length, left, at = int(lengths[k]), int(counts[k]), 0
        while left:
            fits = np.flatnonzero(spaces[at:] >= length)
            if not len(fits):
                each = capacity // length
                new = [((length,) * each, left // each)] * (left >= each) + [((length,) * (left % each), 1)] * (left % each > 0)
                groups += new
                spaces = np.append(spaces, [capacity - sum(p) for p, _ in new])
                break
            at += int(fits[0])
            pattern, many = groups[at]
            each = int(spaces[at]) // length
            full = min(many, left // each)
            left -= full * each
            part = left if full < many and left < each else 0
            left -= part
            split = [(pattern + (length,) * each, full)] * (full > 0) + [(pattern + (length,) * part, 1)] * (part > 0) + [(pattern, many - full - (part > 0))] * (many > full + (part > 0))
            groups[at : at + 1] = split
            spaces = np.concatenate([spaces[:at], [capacity - sum(p) for p, _ in split], spaces[at + 1 :]]).astype(np.int64)
            at += len(split)
    return groups


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, rate: float) -> tuple[dict[bytes, float], float]:
    """Sequences with how often a fractional solution takes them, and a lower bound of any packing's number of sequences.

    Multiplicative weights over the lengths' demands.  Prices are feasible for the dual once divided by the price
    of the dearest sequence, so each round's prices bound the number from below.
    """
    price, bound = lengths / capacity, float(lengths @ counts) / capacity
    amount: dict[bytes, float] = {}
    for _ in range(rounds):
        taken = best_sequence(lengths, price, counts, capacity)
        used = np.flatnonzero(taken)
        worth = float(price @ taken)
        if (taken < counts).all() and worth > 0:  # else the counts kept the sequence from being the dearest one
            bound = max(bound, float(price @ counts) / worth)
        step = float((counts[used] / taken[used]).min())
        amount[taken.tobytes()] = amount.get(taken.tobytes(), 0.0) + step
        price[used] *= np.exp(-rate * step * taken[used] / counts[used])
    # a length is covered `cover` times; scaled by the greatest cover of a sequence's lengths, its whole part is never too much
    cover = sum(np.frombuffer(k, np.int64) * v for k, v in amount.items()) / counts
    return {k: v / max(1.0, float(cover[np.frombuffer(k, np.int64) > 0].min())) for k, v in amount.items()}, bound


def rounded(lengths: np.ndarray, left: np.ndarray, amount: dict[bytes, float], least_fill: float) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole numbers of the fractional solution's sequences that are filled to `least_fill`, and what is left of the counts."""
    out = []
    for key, value in sorted(amount.items(), key=lambda kv: (-int(np.frombuffer(kv[0], np.int64) @ lengths), kv[0])):
        taken = np.frombuffer(key, np.int64)
        used = np.flatnonzero(taken)
        if taken @ lengths < least_fill:
            continue
        many = int(min(value, (left[used] // taken[used]).min()))
        if many > 0:
            left = left - many * taken
            out.append((tuple(np.repeat(lengths, taken)[::-1].tolist()), many))
    return out, left


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = 160, rate: float = 0.5) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for a histogram: (lengths in a sequence, how many such sequences); every piece has exactly one place.

    The program is solved and rounded, and solved again for what is left as long as that takes half of it or more; best-fit
    or first-fit decreasing places the rest.  Sequences count as full from several fills on, and the least number of
    sequences wins.  Should one of the two heuristics alone need fewer, it is taken: no packing is worse than theirs.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if not len(lengths):
        return []
    size = lambda sequences: sum(many for _, many in sequences)
    amount, bound = fractional(lengths, counts, capacity, rounds, rate)
    lower = int(np.ceil(bound - 1e-6))
    best: list[tuple[tuple[int, ...], int]] = []
    for fill in (1.0, 0.998, 0.99, 0.97):
        taken, left = rounded(lengths, counts, amount, fill * capacity)
        for again in (4, 8):
            rest = left > 0
            if not rest.any() or left.sum() * 2 > counts.sum() or (best and size(best) == lower):
                break
            more, _ = fractional(lengths[rest], left[rest], capacity, max(1, rounds // again), rate)
            found, after = rounded(lengths[rest], left[rest], more, fill * capacity)
            taken, left = taken + found, left.copy()
            left[rest] = after
        for place in (fill_up, first_fit):
            whole = taken + place(lengths[left > 0], left[left > 0], capacity)
            if not best or size(whole) < size(best):
                best = whole
        if size(best) == lower:
            return best
    return min((best, fill_up(lengths, counts, capacity), first_fit(lengths, counts, capacity)), key=size)


class Plan:
    """Places by length and rank, from `solve`; its size depends on the number of different lengths alone."""

    def __init__(self, sequences: list[tuple[tuple[int, ...], int]]):
        at: dict[int, int] = {}
        rows, first = [], 0
        for pattern, many in sequences:
            offset = 0
            for length in pattern:
                rows.append((length, at.get(length, 0), first, offset))
                at[length] = at.get(length, 0) + many
                offset += length
            first += many
        self.sequences = first
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.key, self.rank0, self.first, self.offset = (table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length << 44) + rank, side="right") - 1
        return self.first[k] + rank - self.rank0[k], self.offset[k]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns length, part and nth, and any others)."""
    counted = saved(cut.groupBy("length", "part").agg(F.count("*").alias("_n")), "lengths")
    histogram = counted.groupBy("length").agg(F.sum("_n").alias("n")).orderBy("length").collect()  # at most `capacity` rows
    plan = Plan(solve(np.array([r["length"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], np.int64), capacity))
    before = counted.select("length", "part", (F.sum("_n").over(Window.partitionBy("length").orderBy("part")) - F.col("_n")).alias("_before"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = cut.join(before, ["length", "part"]).withColumn("_place", placed("length", F.col("nth") + F.col("_before")))
    kept = [c for c in cut.columns if c not in ("part", "nth")]
    return ranked.select(*kept, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))
