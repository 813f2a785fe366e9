"""The quality gate: how far a compressed context is from its original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import entities, similarity
from turnmill.functions.text import word_set

THRESHOLD = 0.15


def gated(contexts: DataFrame, original: str, compressed: str, threshold: float = THRESHOLD, drift: Column | None = None) -> DataFrame:
    """contexts and drift_score, passed, fallback_used, recommendation, entity_recall, entity_loss.

    Drift is the greater of the words' Jaccard distance (or `drift`, such as a distance of embeddings) and the entities' loss.
    """
    # one expression for both sides: that of names is long
    both = F.array(F.col(original), F.col(compressed))
    sides = {"_names": F.transform(both, entities.all_names), "_words": F.transform(both, word_set)}
    words = similarity.jaccard_distance(F.get("_words", 0), F.get("_words", 1)) if drift is None else drift
    measured = contexts.withColumns(sides).withColumns({"_recall": entities.recall(F.get("_names", 0), F.get("_names", 1)), "_drift": words})
    worst = F.col("_worst")
    advice = F.when(worst <= threshold, "proceed").when(worst <= 2 * threshold, "use_lossless").otherwise("abort_compression")
    judged = measured.withColumn("_worst", F.greatest("_drift", 1 - F.col("_recall"))).withColumns({
        "drift_score": F.round(worst, 4), "passed": worst <= threshold, "fallback_used": F.lit(drift is None), "recommendation": advice,
        "entity_recall": F.round("_recall", 4), "entity_loss": F.round(1 - F.col("_recall"), 4),
    })
    return judged.drop(*sides, "_recall", "_drift", "_worst")
