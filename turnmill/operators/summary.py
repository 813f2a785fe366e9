"""Summaries of turns: extractive sentences, key points, entity lines, and the windows they are made for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.functions import tokens

SENTENCES, EXTRACT_CHARS, SUMMARY_CHARS, NAMES_A_TYPE, KEEP_RECENT, CONFIDENCE = 4, 400, 800, 8, 6, 0.85
SHORTEST_SENTENCE, SHORTEST_WORD, KEY_POINTS = 4, 3, 12
#: Words that carry no topic.  Fixed values.
KEY_POINT_STOPS = (
    "the", "and", "for", "that", "with", "this", "from", "have", "into", "about", "your", "you", "are", "was", "were", "will", "shall", "could", "would", "should",
    "what", "when", "where", "which", "how", "why", "can", "cant", "cannot", "is", "it",
)
STOPS = (*KEY_POINT_STOPS, "a", "an", "of", "to", "in", "on", "at", "by", "or", "be", "do", "did", "has", "had", "not", "but", "if", "as", "so", "we", "he", "she", "they", "i", "me", "my", "our")


def sentences(turns: DataFrame) -> DataFrame:
    """session_id, turn_id, pos, sentence: sentences of four words or more (turns: session_id, turn_id, content)."""
    parts = F.split(T.strip(T.filled("content")), r"(?U)(?<=[.!?])\s+", -1)
    each = turns.select("session_id", "turn_id", F.posexplode(parts).alias("pos", "sentence")).withColumn("sentence", T.strip(F.col("sentence")))
    return each.where(tokens.words(F.col("sentence")) >= SHORTEST_SENTENCE)


def _lower_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\S+"), F.lit(0))


def extractive(turns: DataFrame, most: int = SENTENCES, chars: int = EXTRACT_CHARS) -> DataFrame:
    """session_id, extract: the sentences of most frequent words in their order, cut at `chars`; without sentences the texts."""
    base = sentences(turns)
    each = base.select("session_id", "turn_id", "pos", F.explode(_lower_words(F.col("sentence"))).alias("w"))
    kept = ~F.col("w").isin(*STOPS) & (F.length("w") > SHORTEST_WORD)
    # how often each sentence has a word, so the join back is by distinct words
    held = each.groupBy("session_id", "turn_id", "pos", "w").agg(F.count("*").alias("c"))
    often = held.where(kept).groupBy("session_id", "w").agg(F.sum("c").alias("f"))
    score = held.join(often, ["session_id", "w"], "left").groupBy("session_id", "turn_id", "pos").agg((F.sum(F.col("c") * F.coalesce("f", F.lit(0))) / F.greatest(F.sum("c"), F.lit(1))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "turn_id", "pos"))
    top = base.join(score, ["session_id", "turn_id", "pos"]).withColumn("_r", rank).where(F.col("_r") <= most)
    told = top.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "pos", "sentence"))).alias("s"))
    whole = turns.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", T.filled("content").alias("content")))), lambda x: x["content"]), " ").alias("_all"))
    joined = F.array_join(F.transform("s", lambda x: x["sentence"]), " ")
    return whole.join(told, "session_id", "left").select("session_id", F.substring(F.coalesce(joined, F.col("_all")), 1, chars).alias("extract"))


def entity_line(edges: DataFrame, most: int = NAMES_A_TYPE) -> DataFrame:
    """session_id, entity_line (edges: session_id, turn_id, etype, ord, pos, name): types and names in the order they came."""
    first = edges.groupBy("session_id", "etype", "name").agg(F.min(F.struct("turn_id", "ord", "pos")).alias("at"))
    types = first.groupBy("session_id", "etype").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "name"))).alias("n"))
    line = F.concat(F.col("etype"), F.lit("s: "), F.array_join(F.transform(F.slice("n", 1, most), lambda x: x["name"]), ", "))
    lines = types.select("session_id", F.struct("at", line.alias("line")).alias("l")).groupBy("session_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return lines.select("session_id", F.concat(F.lit("[Entities] "), F.array_join(F.transform("l", lambda x: x["line"]), "; ")).alias("entity_line"))


def merged(existing: Column, extract: Column, line: Column, chars: int = SUMMARY_CHARS) -> Column:
    """The rolling summary: what there was, the extract and the entity line."""
    return F.substring(F.array_join(F.filter(F.array(*map(T.filled, (existing, extract, line))), lambda p: p != ""), " | "), 1, chars)


def key_points(turns: DataFrame, chars: int = 500) -> DataFrame:
    """session_id, summary: the twelve most frequent words that carry a topic, ties by first place; without such words the text."""
    rows = turns.where(T.filled("content") != "").groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "content"))), lambda x: x["content"]), " ").alias("all"))
    words = rows.select("session_id", F.posexplode(F.regexp_extract_all(F.lower("all"), F.lit(r"(?U)\b[a-z]{3,}\b"), F.lit(0))).alias("pos", "w")).where(~F.col("w").isin(*KEY_POINT_STOPS))
    counts = words.groupBy("session_id", "w").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("c"), "p"))).where(F.col("_r") <= KEY_POINTS)
    told = top.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "w"))), lambda x: x["w"]), ", ").alias("points"))
    return rows.join(told, "session_id", "left").select("session_id", F.substring(F.coalesce(F.concat(F.lit("Key points: "), F.col("points")), F.col("all")), 1, chars).alias("summary"))


def windowed(turns: DataFrame, keep: int = KEEP_RECENT) -> DataFrame:
    """turns and recent: whether a turn is among its session's last `keep`."""
    return turns.withColumn("recent", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_id"))) <= keep)


def over_budget(turns: DataFrame, budget: int, keep: int = KEEP_RECENT) -> DataFrame:
    """turns (with tokens) and session_tokens, compress: older turns of sessions over the budget."""
    total = F.sum("tokens").over(Window.partitionBy("session_id")) + tokens.LIST_TOKENS
    sized = windowed(turns, keep).withColumn("session_tokens", total)
    return sized.withColumn("compress", (F.col("session_tokens") > budget) & ~F.col("recent"))


def shrunk(turns: DataFrame, summary: str = "summary", budget: int = 800, recent: int = 4) -> DataFrame:
    """session_id, kept_turns, context: the chat endpoint's context with the greatest window of recent turns that fits the budget, one turn at least.

    turns: session_id, turn_id, role, content; `summary` is a column of the session.
    """
    lists = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "role", "content"))).alias("t"), F.any_value(summary).alias("_s"))
    sizes = F.sequence(F.lit(recent), F.lit(1), F.lit(-1))
    options = F.transform(sizes, lambda n: F.struct(n.alias("n"), T.rendered_chat(F.col("_s"), F.col("t"), n).alias("context")))
    fitting = F.filter(options, lambda o: tokens.words(o["context"]) <= budget)
    best = F.coalesce(F.get(fitting, 0), F.get(options, recent - 1))
    return lists.withColumn("_b", best).select("session_id", F.least(F.size("t"), F.col("_b.n")).cast("long").alias("kept_turns"), F.col("_b.context").alias("context"))
