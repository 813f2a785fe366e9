"""Relevance of turns and chunks to a query, pruning, and packing into a budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField

from turnmill.functions import similarity, tokens
from turnmill.functions.text import word_set

from . import ordered, reuse

THRESHOLD, ENTITY_WEIGHT, LOAD_BEARING, CHUNK_BUDGET = 0.15, 0.3, 0.1, 4000


def keyword_score(text: Column, query: Column) -> Column:
    # bound as a lambda's variable, so that each set is made once
    both = F.array(F.struct(word_set(text).alias("text"), word_set(query).alias("query")))
    return F.get(F.transform(both, lambda w: similarity.ochiai(w["text"], w["query"])), 0)


def with_entities(base: Column, names: Column, query_names: Column) -> Column:
    """The score and a bonus for the query's entities that a turn names, 1 at most."""
    return F.when(F.size(query_names) > 0, F.least(F.lit(1.0), base + ENTITY_WEIGHT * similarity.share_of(query_names, names))).otherwise(base)


def scored(turns: DataFrame, content: str = "content", query: str = "query", names: str | None = None, query_names: str | None = None, vectors: tuple[str, str] | None = None) -> DataFrame:
    """turns and score, rounded to 4: by common words, or by the cosine of two vector columns (a turn's and the query's)."""
    base = similarity.cosine(*map(F.col, vectors)) if vectors else keyword_score(F.col(content), F.col(query))
    return turns.withColumn("score", F.round(with_entities(base, F.col(names), F.col(query_names)) if names and query_names else base, 4))


def load_bearing(edges: DataFrame, queries: DataFrame, least: float = LOAD_BEARING) -> DataFrame:
    """session_id, turn_id of turns to protect: those naming `least` or more of the query's entities, and where each of these was named first.

    edges: session_id, turn_id, name; queries: session_id, name.
    """
    asked = queries.select("session_id", "name").distinct()
    many = asked.groupBy("session_id").agg(F.count("*").alias("_n"))
    hits = edges.select("session_id", "turn_id", "name").distinct().join(asked, ["session_id", "name"])
    often = hits.groupBy("session_id", "turn_id").agg(F.count("*").alias("_hit")).join(many, "session_id").where(F.col("_hit") / F.col("_n") >= least).select("session_id", "turn_id")
    first = hits.groupBy("session_id", "name").agg(F.min("turn_id").alias("turn_id")).select("session_id", "turn_id")
    return often.union(first).distinct()


def pruned(scored_turns: DataFrame, threshold: float = THRESHOLD, protected: str | None = None, lossless: bool = False) -> DataFrame:
    """turns and kept_rel: protected, or of `threshold` or more; all if lossless."""
    if lossless:
        return scored_turns.withColumn("kept_rel", F.lit(True))
    keep = F.col("score") >= threshold
    return scored_turns.withColumn("kept_rel", keep | F.coalesce(F.col(protected), F.lit(False)) if protected else keep)


def prune_confidence(kept: str = "kept_rel", score: str = "score", standalone: bool = False) -> Column:
    """Confidence of a session's pruning: 1 - the greatest removed score; standalone: the least removed score; 1 if nothing went."""
    gone = F.when(~F.col(kept), F.col(score))
    return F.round(F.coalesce(F.min(gone) if standalone else 1 - F.max(gone), F.lit(1.0)), 4)


class Packing:
    """The tokens used so far and the rows seen: a row is kept if it still fits."""

    takes = ("tokens",)

    def __init__(self, budget: int):
        self.budget = budget
        self.gives = [StructField("rank", IntegerType()), StructField("kept", BooleanType())]

    def begin(self) -> tuple[int, int]:
        return 0, 0

    def move(self, state: tuple[int, int], size: int | None) -> tuple[tuple[int, int], tuple]:
        used, rank = state
        fits = size is not None and used + size <= self.budget
        return (used + size if fits else used, rank + 1), (rank + 1, fits)

    def transition(self) -> PackingTransition:
        return PackingTransition(self.budget)


class PackingTransition:
    """What every number of tokens used before comes to: starts that have come to the same number go on as one."""

    def __init__(self, budget: int):
        self.budget, self.rows = budget, 0
        # of begin u the tokens used are used[place[u]]
        self.used, self.place = np.arange(budget + 1), np.arange(budget + 1)

    def add(self, size: int | None) -> None:
        self.rows += 1
        if size is not None and 0 < size <= self.budget:
            self.used = np.where(self.used + size <= self.budget, self.used + size, self.used)
            if self.rows % 1024 == 0:
                self.used, back = np.unique(self.used, return_inverse=True)
                self.place = back[self.place]

    def of(self, state: tuple[int, int]) -> tuple[int, int]:
        return int(self.used[self.place[state[0]]]), state[1] + self.rows


def packed(chunks: DataFrame, query_id: str, chunk_id: str, content: str, budget: int = CHUNK_BUDGET) -> DataFrame:
    """query_id, chunk_id, rank, score, tokens, kept (columns of `scored` chunks): by score, each chunk that still fits is taken, others are skipped.

    A query's chunks may be as many as they like: they are folded in ranges of their order.
    """
    sized = chunks.select(F.col(query_id).alias("query_id"), F.col(chunk_id).alias("chunk_id"), "score", tokens.words(F.col(content)).cast("long").alias("tokens"))
    return ordered.folded(reuse.once(sized), "query_id", [F.desc("score"), F.asc("chunk_id")], Packing(budget)).select("query_id", "chunk_id", "rank", "score", "tokens", "kept")
