"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words of `[^\\x20\\x09-\\x0D]+`.  The sources' targets share the total by weight; a
target stops at `most` times its source's size and the excess goes to the others by weight
(water-filling over the sources in the order of size by weight).  A source's rate is its target
by its size: each document is emitted floor(rate) times, and once more with a probability of
the rate's fraction, drawn from a hash of the document and the source's seed.  Of `seeds` seeds
a source takes the one whose draw comes nearest to its target, so reruns agree and a few very
long documents don't carry a source far from its target.

A null or empty text has size 0 and takes nothing.  The null source is a source and stands last.
Repeated rows are drawn alike.  A source of size 0 has target 0.  Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_of, saved

#: Up to so many sources are broadcast (a few hundred bytes each); more are joined by shuffle.
MAX_BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mark(docs: DataFrame) -> Column:
    """What a document's draw depends on: its id and text."""
    return F.xxhash64("doc_id", "text")


def drawn(seed: Column, fraction: Column) -> Column:
    """1 with a probability of `fraction`, from the document's mark and the seed."""
    return (F.shiftrightunsigned(F.xxhash64("_mark", seed), 11) * F.lit(2.0**-53) < fraction).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """source, source_size, target, from one row for each source (source, source_size)."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((order - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * most)
    # sources whose cap is small for their weight come first: up to some source all are capped
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0).cast("long")
    rest = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(before), zero)
    rest_w = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), zero)
    level = weighed.withColumn("_level", rest / rest_w).withColumn("_full", F.col("_level") * F.col("_w") > F.col("_cap"))
    # the level at the first source that isn't capped, of equal ratios the one of greatest level, holds for it and all after it
    final = -F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), (-F.col("_level")).alias("_down")))).over(everything)["_down"]
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), final * F.col("_w")))
    return level.select("source", "source_size", target.alias("target"))


def _near(df: DataFrame, small: DataFrame, on: Column) -> DataFrame:
    few = small.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    return df.join(F.broadcast(small) if few else small, on, "left")


def rates(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seeds: int = 32) -> DataFrame:
    """_source, source_size, target, _whole, _fraction, _seed, from source, size and _mark of every document."""
    per_source = saved(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    goal = targets(per_source, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate).cast("long")
    goal = saved(goal.select(F.col("source").alias("_source"), "source_size", "target", whole.alias("_whole"), (rate - whole).alias("_fraction")), "targets")
    tried = _near(sized, goal, F.col("source").eqNullSafe(F.col("_source")))
    sums = [F.sum(F.col("size") * drawn(F.lit(k), F.col("_fraction"))).alias(f"s{k}") for k in range(seeds)]
    taken = tried.groupBy("_source").agg(*sums)
    missing = F.col("target") - F.col("source_size") * F.col("_whole")
    off = F.array(*[F.abs(F.col(f"s{k}") - missing) for k in range(seeds)])
    chosen = goal.join(taken.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of")), "left")
    return saved(chosen.select("_source", "source_size", "target", "_whole", "_fraction", (F.array_position(off, F.array_min(off)) - 1).cast("int").alias("_seed")), "rates")


def with_copies(docs: DataFrame, rate: DataFrame) -> DataFrame:
    """docs (with source, size and _mark) and source_size, target and copies."""
    joined = _near(docs, rate, docs["source"].eqNullSafe(rate["_source"]))
    copies = F.col("_whole") + drawn(F.col("_seed"), F.col("_fraction"))
    return joined.withColumn("copies", F.coalesce(copies, F.lit(0))).drop("_source", "_whole", "_fraction", "_seed")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, copies of every document."""
    sized = saved(docs.select("doc_id", "source", words(docs["text"]).alias("size"), mark(docs).alias("_mark")), "sized")
    return with_copies(sized, rates(sized, **settings)).select("doc_id", "size", "source_size", "target", "copies")


def emitted(docs: DataFrame, **settings) -> DataFrame:
    """The documents as the mix takes them: each as often as it has copies, with the columns of docs."""
    sized = saved(docs.select("source", words(docs["text"]).alias("size"), mark(docs).alias("_mark")), "sized")
    rate = rates(sized, **settings).drop("source_size", "target")
    rows = docs.select(row_of(docs).alias("row"), F.col("source").alias("_of"), mark(docs).alias("_mark"))
    joined = _near(rows, rate, F.col("_of").eqNullSafe(F.col("_source")))
    copies = F.coalesce(F.col("_whole") + drawn(F.col("_seed"), F.col("_fraction")), F.lit(0))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_copy")).select("row.*")
