"""The compression plan of whole conversations: what each stage removes and what that saves.

turns(session_id, turn_id, role, content) go through structural cleaning, near-duplicate
removal, relevance pruning and a budget with a rolling summary.  A stage adds columns and
removes nothing, so each saved token is attributed by the first stage that dropped its turn.
Sessions that fail the quality gate take the figures of the plan without pruning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import entities, structural, tokens
from turnmill.functions import text as T
from turnmill.operators import dedup, quality, relevance, reuse, summary
from turnmill.sources import chat

STAGES = ("deduplication", "relevance", "summarization")


@dataclass(frozen=True)
class Settings:
    mode: str = "lossy"
    dedup_threshold: float = dedup.THRESHOLD
    relevance_threshold: float = relevance.THRESHOLD
    max_history_tokens: int = 4000
    max_summary_chars: int = summary.SUMMARY_CHARS
    keep_recent: int = summary.KEEP_RECENT
    gate_threshold: float = quality.THRESHOLD
    with_entities: bool = True
    may_hold_json: bool = True
    model: str = "gpt-4o"
    counter: Callable[[Column], Column] = tokens.words  # such as tokens.bpe_counter(path)
    vector: str | None = None  # a column of the turns: similarity by their vectors' cosine and not by words


def _tasks(df: DataFrame) -> int:
    """How many tasks share what takes far more time than its bytes say (of the latter Spark would make fewer)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cleaned(turns: DataFrame, settings: Settings, query: str) -> DataFrame:
    """History turns with system, query, clean text, tokens, scores, protected and near-duplicate marks: what all modes share.

    Turns are dealt out by session once, and what follows stays where it is; what is found in each turn's text is kept
    for all that reads it.
    """
    by_session = turns.repartition(_tasks(turns), "session_id")
    parts = chat.split(by_session, query)
    if settings.mode != "lossless" and settings.with_entities:
        parts = parts.withColumn("_asked", entities.all_names(F.col("query")))  # once a session, not once a turn
    if settings.vector:
        asked = by_session.select("session_id", F.col("turn_id").alias("query_turn"), F.col(settings.vector).alias("_query_vector"))
        parts = parts.join(asked, ["session_id", "query_turn"], "left")
    vectors = (settings.vector, "_query_vector") if settings.vector else None
    history = chat.history(by_session, parts)
    clean = history.withColumn("clean", structural.compress(F.col("content"), settings.may_hold_json))
    count = lambda c: tokens.of_turn(F.col("role"), F.col(c), settings.model, settings.counter)
    sized = clean.withColumns({"raw_tokens": count("content"), "tokens": count("clean")})
    if settings.mode != "lossless" and settings.with_entities:
        named = sized.withColumn("_names", entities.all_names(F.col("clean")))
        sized = relevance.scored(named.withColumn("_hit", F.array_intersect("_asked", "_names")), "clean", "query", "_names", "_asked", vectors).drop("_names")
    elif settings.mode != "lossless":
        sized = relevance.scored(sized, "clean", "query", vectors=vectors)
    sized = reuse.once(sized.drop("_query_vector"))
    marked = dedup.deduplicated(sized, "session_id", "turn_id", "clean", settings.dedup_threshold, None if settings.vector else dedup.large(turns, "session_id"), settings.vector).withColumnRenamed("kept", "kept_dedup")
    if settings.mode == "lossless" or not settings.with_entities:
        return marked
    # a turn that names a tenth of the query's entities is protected, and so is the turn that named one of them first;
    # with ten entities or fewer every turn that names one is the former, so only longer queries need the search
    few = int(1 / relevance.LOAD_BEARING)
    long_ = sized.where(F.size("_asked") > few).select("session_id", "turn_id", F.explode("_hit").alias("name"))
    first = long_.groupBy("session_id", "name").agg(F.min("turn_id").alias("turn_id")).select("session_id", "turn_id", F.lit(True).alias("_first")).distinct()
    protected = (F.size("_hit") / F.size("_asked") >= relevance.LOAD_BEARING) | F.coalesce("_first", F.lit(False))
    return marked.join(first, ["session_id", "turn_id"], "left").withColumn("_protected", (F.size("_asked") > 0) & protected).drop("_asked", "_hit", "_first")


def _judged(cleaned: DataFrame, settings: Settings) -> DataFrame:
    """Adds score and kept_rel; lossless keeps all."""
    if settings.mode == "lossless":
        return cleaned.withColumn("score", F.lit(None).cast("double")).withColumn("kept_rel", F.lit(True))
    if not settings.with_entities:
        return relevance.pruned(cleaned, settings.relevance_threshold)
    return relevance.pruned(cleaned, settings.relevance_threshold, "_protected").drop("_protected")


def _staged(judged: DataFrame, settings: Settings, kept: str = "kept_rel", suffix: str = "") -> DataFrame:
    """Adds stage (which stage drops a turn; null for turns that stay) and over_budget, from kept_dedup and the column `kept`."""
    stays = F.col("kept_dedup") & F.col(kept)
    # places and totals among the turns that stay
    session = Window.partitionBy("session_id")
    left = F.sum(F.when(stays, F.col("tokens")).otherwise(0)).over(session) + tokens.LIST_TOKENS
    after = F.count(F.when(stays, 1)).over(session.orderBy(F.desc("turn_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = judged.withColumn("_left", left).withColumn("_after", after)
    over = F.col("_left") > settings.max_history_tokens
    stage = F.when(~F.col("kept_dedup"), "deduplication").when(~F.col(kept), "relevance").when(stays & over & (F.col("_after") > settings.keep_recent), "summarization")
    return placed.withColumns({f"stage{suffix}": stage, f"over_budget{suffix}": over}).drop("_left", "_after")


def annotated(turns: DataFrame, settings: Settings, query: str = "last_user") -> DataFrame:
    """History turns with system, query, their clean text, scores, and which stage drops them (stage is null for turns that stay)."""
    return _staged(_judged(_cleaned(turns, settings, query), settings), settings)


def _sums(suffix: str = "") -> list[Column]:
    """A session's sums over its turns, for the stages of one mode."""
    dropped = lambda s: F.col(f"stage{suffix}") == s
    gone = [F.coalesce(F.sum(F.when(dropped(s), F.col("tokens"))), F.lit(0)).alias(s) for s in STAGES]
    return [
        F.count("*").alias("turns"), F.count(F.when(F.col(f"stage{suffix}").isNull(), 1)).alias("turns_kept"), F.sum("raw_tokens").alias("_raw"), F.sum("tokens").alias("_clean"), *gone,
        F.coalesce(F.min(F.when(dropped("deduplication"), F.col("dedup_similarity"))), F.lit(1.0)).alias("_c1"),
        F.coalesce(1 - F.max(F.when(dropped("relevance"), F.col("score"))), F.lit(1.0)).alias("_c2"),
        F.max(F.when(F.col(f"over_budget{suffix}"), summary.CONFIDENCE)).alias("_c3"),
    ]


def _figures(joined: DataFrame, settings: Settings, *more: str) -> DataFrame:
    """The columns of `measured`, and `more`, from parts and sums."""
    joined = joined.fillna(0, ["turns", "turns_kept", "_raw", "_clean", *STAGES])
    clean_system = structural.compress(F.col("system"), settings.may_hold_json)
    count = lambda c: tokens.count(c, settings.model, settings.counter)
    fixed = count(F.col("query")) + tokens.LIST_TOKENS
    raw = count(F.col("system")) + F.col("_raw") + fixed
    post = count(clean_system) + F.col("_clean") - F.col("deduplication") - F.col("relevance") - F.col("summarization") + fixed
    cleaned = F.greatest(count(F.col("system")) - count(clean_system) + F.col("_raw") - F.col("_clean"), F.lit(0))
    out = joined.select(
        "session_id", F.col("turns"), F.col("turns_kept"), raw.alias("raw_tokens"), post.alias("post_tokens"), cleaned.alias("structural"), *STAGES,
        F.round(F.least(F.coalesce("_c1", F.lit(1.0)), F.coalesce("_c2", F.lit(1.0)), F.coalesce("_c3", F.lit(1.0))), 4).alias("confidence"), F.col("_c3").isNotNull().alias("summarized"), *more,
    )
    total = F.greatest(F.col("raw_tokens") - F.col("post_tokens"), F.lit(0))
    adjusted = total - (F.col("structural") + F.col("deduplication") + F.col("relevance") + F.col("summarization"))
    lossy = F.greatest(*STAGES, adjusted) > 0
    mode = F.lit("lossless") if settings.mode == "lossless" else F.when(lossy, "lossy").otherwise("lossless")
    return out.withColumns({"token_savings": total, "adjustment": adjusted, "pct_saved": tokens.percent(F.col("raw_tokens"), F.col("post_tokens")), "mode": mode})


def measured(turns: DataFrame, plan: DataFrame, settings: Settings, query: str = "last_user") -> DataFrame:
    """One row a session: raw and post tokens, what each stage saved, confidence and mode."""
    return _figures(chat.split(turns, query).join(plan.groupBy("session_id").agg(*_sums()), "session_id", "left"), settings)


def _texts() -> list[Column]:
    """A session's turns before and after, in order."""
    return [
        F.array_sort(F.collect_list(F.struct("turn_id", "role", "content"))).alias("_b"),
        F.array_sort(F.collect_list(F.when(F.col("stage").isNull(), F.struct("turn_id", "role", F.col("clean").alias("content"))))).alias("_a"),
    ]


def _told(plan: DataFrame) -> DataFrame:
    """session_id, extract of the turns that the summary stands for."""
    return summary.extractive(plan.where("stage = 'summarization'").select("session_id", "turn_id", F.col("clean").alias("content")))


def _sides() -> tuple[Column, Column]:
    """The context texts before and after, from system, _b, _a and extract."""
    none = F.array().cast("array<struct<turn_id:bigint,role:string,content:string>>")
    line = F.substring(F.coalesce("extract", F.lit("")), 1, summary.SUMMARY_CHARS)
    before = T.rendered_context(F.col("system"), F.lit(""), F.coalesce("_b", none))
    return before.alias("original"), T.rendered_context(structural.compress(F.col("system")), line, F.coalesce("_a", none)).alias("compressed")


def contexts(turns: DataFrame, plan: DataFrame, query: str = "last_user") -> DataFrame:
    """session_id, original, compressed: the context texts before and after (with the summary of what was compressed)."""
    parts = chat.split(turns, query).select("session_id", "system")
    joined = parts.join(plan.groupBy("session_id").agg(*_texts()), "session_id", "left").join(_told(plan), "session_id", "left")
    return joined.select("session_id", *_sides())


def gated(turns: DataFrame, settings: Settings = Settings(), query: str = "last_user") -> DataFrame:  # noqa: B008
    """`measured` with the gate's verdict; sessions that fail take the lossless plan's figures.

    Both modes share all but the last steps: one table of turns holds the stages of both, and one aggregate their sums.
    """
    if settings.mode == "lossless":
        return measured(turns, annotated(turns, settings, query), settings, query).withColumn("gate", F.lit(None).cast("string"))
    judged = _staged(_judged(_cleaned(turns, settings, query), settings), settings)
    plan = reuse.once(_staged(judged.withColumn("_all", F.lit(True)), settings, "_all", "_lossless"))
    named = lambda columns, name: F.struct(*columns).alias(name)
    per = plan.groupBy("session_id").agg(named(_sums(), "_lossy"), named(_sums("_lossless"), "_safe"), *_texts())
    parts = chat.split(turns, query).join(per, "session_id", "left").join(_told(plan), "session_id", "left")
    told = parts.withColumns(dict(zip(("original", "compressed"), _sides(), strict=True))).drop("_b", "_a", "extract").repartition(_tasks(turns), "session_id")
    verdict = quality.gated(told, "original", "compressed", settings.gate_threshold).withColumn("gate", F.col("recommendation"))
    chosen = F.when(F.col("passed"), F.col("_lossy")).otherwise(F.col("_safe"))
    both = verdict.withColumn("_chosen", chosen).select("session_id", "system", "query", "_chosen.*", "drift_score", "passed", "gate")
    out = _figures(both, settings, "drift_score", "passed", "gate")
    return out.withColumn("mode", F.when(F.col("passed"), F.col("mode")).otherwise("lossless"))
