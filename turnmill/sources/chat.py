"""Chat payloads and logs as tables of turns, and what is sent back.

The core relation is turns(session_id, turn_id, role, content).  A null content is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import tokens
from turnmill.functions.text import filled

DEFAULT_SYSTEM = "You are a helpful assistant."
_MESSAGES = "array<struct<role: string, content: string>>"
REQUEST = f"model string, messages {_MESSAGES}, compression_mode string, max_history_tokens int, relevance_threshold double, dedup_threshold double, session_id string, temperature double, max_tokens int, stream boolean"
LOG = f"messages {_MESSAGES}, request struct<messages: {_MESSAGES}>"


def _json_lines(spark: SparkSession, path: str, schema: str, streaming: bool) -> DataFrame:
    """JSON lines as rows; a line that is none is kept as it stands in the column bad, and its other columns are null."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(f"{schema}, bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)


def read_requests(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Chat requests from JSON lines; content that is no string stays as its JSON text, a bad line is kept in the column bad."""
    return _json_lines(spark, path, REQUEST, streaming)


def read_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Conversations (conv_id, messages) from JSON lines with messages, or request.messages, at the top; other lines have neither, and bad ones stand in the column bad."""
    lines = _json_lines(spark, path, LOG, streaming).select(F.coalesce("messages", "request.messages").alias("messages"), "bad")
    held = F.size("messages") > 0
    return lines.where(held | F.col("bad").isNotNull()).select(F.when(held, F.xxhash64(F.to_json("messages"))).alias("conv_id"), "messages", "bad")


def turns_of(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each message of `messages`."""
    each = conversations.select(F.col(key).alias("session_id"), F.posexplode("messages").alias("turn_id", "m"))
    return each.select("session_id", F.col("turn_id").cast("long").alias("turn_id"), "m.role", F.col("m.content").alias("content"))


def from_table(conversations: DataFrame) -> DataFrame:
    """Turns from a table (conv_id, turn, role, text)."""
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), "role", F.col("text").alias("content"))


def flatten_content(content: Column) -> Column:
    """Plain text of a message's content: a string as it is; of blocks the texts, [image] for images, joined by line ends; null is empty."""
    block = "array<struct<type: string, text: string>>"
    text = lambda b: F.when(b["type"] == "image_url", F.lit("[image]")).otherwise(F.coalesce(b["text"], F.lit("")))
    plain = F.from_json(content, "array<string>")
    blocks = F.from_json(content, block)
    # a bare string within the list has no fields: it is read as text
    parts = F.transform(blocks, lambda b, i: F.when(b.isNull() | (b["type"].isNull() & b["text"].isNull()), F.when(~F.get(plain, i).startswith("{"), F.get(plain, i))).otherwise(text(b)))
    return F.when(F.ltrim(content).startswith("[{") | F.ltrim(content).startswith('["'), F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n")).otherwise(filled(content))


def split(turns: DataFrame, query: str = "last_user") -> DataFrame:
    """session_id, system, query, query_turn and system_turn of every session, by one aggregate.

    system is the first system message that isn't empty.  query is the last user message
    ("last_user", for logs), or the last turn if it is the user's, else empty ("last_turn", for requests).
    """
    content, turn, is_system = filled("content"), F.col("turn_id"), F.coalesce(F.col("role") == "system", F.lit(False))
    text = F.struct(turn.alias("turn"), content.alias("content"))
    prompt = F.min(F.when(is_system & (content != ""), text))
    asked = F.max(F.when(F.col("role") == "user", text))
    found = turns.groupBy("session_id").agg(prompt.alias("_s"), asked.alias("_u"), F.max(F.when(is_system, turn)).alias("_ls"), F.max(F.when(~is_system, turn)).alias("_lo"))
    if query != "last_user":
        # the last turn is a system message's only if it comes after the prompt
        later = (F.col("_ls") > F.col("_s.turn")) & (F.col("_lo").isNull() | (F.col("_ls") > F.col("_lo")))
        found = found.withColumn("_u", F.when(~F.coalesce(later, F.lit(False)) & (F.col("_u.turn") == F.col("_lo")), F.col("_u")))
    return found.select("session_id", F.coalesce("_s.content", F.lit("")).alias("system"), F.coalesce("_u.content", F.lit("")).alias("query"), F.col("_u.turn").alias("query_turn"), F.col("_s.turn").alias("system_turn"))


def history(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns that are neither the system prompt, nor an empty system message before it, nor the query, with system and query beside them."""
    joined = turns.join(parts, "session_id")
    is_system = F.coalesce(F.col("role") == "system", F.lit(False))
    head = is_system & (F.col("system_turn").isNull() | (F.col("turn_id") <= F.col("system_turn")))
    return joined.where(~head & (F.col("query_turn").isNull() | (F.col("turn_id") != F.col("query_turn")))).withColumn("content", filled("content"))


def synthetic(topics: DataFrame, turns: int) -> DataFrame:
    """A templated history for each topic (session_id, topic): the user asks about it, the assistant answers, so many turns in all."""
    grid = topics.select("session_id", "topic", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn_id"))
    user = F.col("turn_id") % 2 == 0
    said = F.when(user, F.concat(F.lit("Can you explain "), "topic", F.lit("?"))).otherwise(F.concat(F.lit("Here is how "), "topic", F.lit(" works, step by step.")))
    return grid.select("session_id", "turn_id", F.when(user, "user").otherwise("assistant").alias("role"), said.alias("content"))


def authorised(authorization: Column, api_key: Column, expected: str | None) -> Column:
    """Whether a request names the expected key, as a bearer token or, without one, as an API key; without an expected key all do."""
    if not expected:
        return F.lit(True)
    bearer = F.regexp_extract(F.trim(filled(authorization)), r"(?i)^Bearer\s+(.+)$", 1)
    return F.when(bearer != "", bearer).otherwise(F.trim(filled(api_key))) == expected


def payload(system: Column, summary: Column, turns: Column, query: Column, model: Column, prefix_hit: Column, temperature: Column, max_tokens: Column) -> Column:
    """The JSON that a provider gets: a summary as an exchange before the history; the system prompt as a message, or as a field for claude models."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    none = F.array().cast(_MESSAGES)
    recap = F.when(filled(summary) != "", F.array(say("user", F.concat(F.lit("[Context summary]\n"), summary)), say("assistant", F.lit("Understood.")))).otherwise(none)
    told = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["content"], F.lit("")).alias("content")))
    messages = F.concat(recap, told, F.when(filled(query) != "", F.array(say("user", query))).otherwise(none))
    limit = F.coalesce(max_tokens, F.lit(4096)).alias("max_tokens")
    cached = F.when(prefix_hit, F.struct(F.lit("ephemeral").alias("type"))).alias("cache_control")
    block = F.when(filled(system) != "", F.array(F.struct(F.lit("text").alias("type"), system.alias("text"), cached))).alias("system")
    claude = F.to_json(F.struct(model.alias("model"), limit, temperature.alias("temperature"), block, messages.alias("messages")))
    headed = F.concat(F.when(filled(system) != "", F.array(say("system", system))).otherwise(none), messages)
    return F.when(F.lower(model).startswith("claude"), claude).otherwise(F.to_json(F.struct(model.alias("model"), headed.alias("messages"), temperature.alias("temperature"), max_tokens.alias("max_tokens"))))


def dry_run(system: Column, contents: Column, query: Column) -> Column:
    """Prompt tokens of a response that isn't asked for: words of system prompt, history and query."""
    return tokens.words(system) + F.aggregate(contents, F.lit(0).cast("long"), lambda s, t: s + tokens.words(t)) + tokens.words(query)


def event_stream(responses: DataFrame) -> DataFrame:
    """The rows of a streamed response (request_id, text): role, text, end, and the closing mark."""
    delta = lambda **x: F.to_json(F.struct(F.lit("chat.completion.chunk").alias("object"), F.struct(*[v.alias(k) for k, v in x.items()]).alias("delta")))
    end = F.to_json(F.struct(F.lit("chat.completion.chunk").alias("object"), F.lit("stop").alias("finish_reason")))
    chunks = F.array(delta(role=F.lit("assistant")), delta(content=filled("text")), end, F.lit("[DONE]"))
    return responses.select("request_id", F.posexplode(chunks).alias("seq", "data")).withColumn("data", F.concat(F.lit("data: "), F.col("data"), F.lit("\n\n")))


def models(spark: SparkSession) -> DataFrame:
    """The models that a client may list."""
    return spark.createDataFrame([(m, "model", o) for m, o in tokens.LISTED_MODELS], "id string, object string, owned_by string")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
