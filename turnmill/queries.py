"""Queries over the test tables, one for each operator, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import entities, similarity, structural, tokens
from turnmill.functions import text as T
from turnmill.operators import cache, dedup, graph, largeblocks, quality, relevance, reuse, session, summary, telemetry
from turnmill.plans import savings
from turnmill.sources import chat
from turnmill.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Parts that several SQL queries share.
_TURNS = "turns AS (SELECT conv_id AS session_id, turn AS turn_id, role, coalesce(text, '') AS content FROM conversations)"
_SPLIT = """first_system AS (SELECT session_id, min(turn_id) AS system_turn, arg_min(content, turn_id) AS system FROM turns WHERE role = 'system' AND content <> '' GROUP BY session_id),
last_user AS (SELECT session_id, max(turn_id) AS query_turn, arg_max(content, turn_id) AS query FROM turns WHERE role = 'user' GROUP BY session_id),
parts AS (SELECT s.session_id, coalesce(f.system, '') AS system, coalesce(l.query, '') AS query, l.query_turn, f.system_turn
  FROM (SELECT DISTINCT session_id FROM turns) s LEFT JOIN first_system f USING (session_id) LEFT JOIN last_user l USING (session_id)),
history AS (SELECT t.*, p.system, p.query FROM turns t JOIN parts p USING (session_id)
  WHERE NOT (t.role = 'system' AND (p.system_turn IS NULL OR t.turn_id <= p.system_turn)) AND (p.query_turn IS NULL OR t.turn_id <> p.query_turn))"""
_WS = r"""regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace({0}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda l: regexp_replace(l, '\s+$', '')), chr(10)), '^\s+|\s+$', '', 'g')"""
_PUNCT = r"""regexp_replace(regexp_replace(regexp_replace({0}, '!{{2,}}', '!', 'g'), '\?{{2,}}', '?', 'g'), '\.{{4,}}', '...', 'g')"""
_CLEAN = _WS.format(_PUNCT.format("content"))
_TOK = r"CAST(len(regexp_extract_all({0}, '\S+')) AS BIGINT)"
_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9'']+')"
_OCHIAI = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1})) / sqrt(CAST(len({0}) AS DOUBLE) * len({1})) ELSE 0.0 END"
_VECTORS = f"""words AS (SELECT session_id AS block, turn_id AS row, {_WORDS.format("content")} AS w FROM rows_in),
sizes AS (SELECT block, count(*) AS n FROM words GROUP BY block),
terms AS (SELECT block, row, len(w) AS len, term, count(*) AS c FROM (SELECT block, row, w, unnest(w) AS term FROM words) GROUP BY ALL),
held AS (SELECT block, term, count(*) AS df FROM terms GROUP BY ALL),
weighed AS (SELECT block, row, term, c / len * (ln((n + 1) / (df + 1)) + 1) AS weight FROM terms JOIN held USING (block, term) JOIN sizes USING (block)),
norms AS (SELECT block, row, sqrt(sum(weight * weight)) AS norm FROM weighed GROUP BY ALL),
pairs AS (SELECT x.block, x.row AS a, y.row AS b, sum(x.weight / nx.norm * y.weight / ny.norm) AS similarity
  FROM weighed x JOIN weighed y ON x.block = y.block AND x.term = y.term AND x.row < y.row JOIN norms nx ON nx.block = x.block AND nx.row = x.row JOIN norms ny ON ny.block = y.block AND ny.row = y.row GROUP BY ALL)"""
_GREEDY = """numbered AS (SELECT session_id AS block, turn_id AS row, row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS i FROM rows_in),
linked AS (SELECT block, b AS row, list(a) AS before FROM pairs WHERE similarity >= {0} GROUP BY ALL),
steps AS (SELECT n.*, coalesce(l.before, []) AS before FROM numbered n LEFT JOIN linked l USING (block, row)),
fold AS (SELECT block, i, row, [row] AS kept FROM steps WHERE i = 1
  UNION ALL SELECT s.block, s.i, s.row, CASE WHEN len(list_intersect(f.kept, s.before)) > 0 THEN f.kept ELSE list_append(f.kept, s.row) END FROM fold f JOIN steps s ON s.block = f.block AND s.i = f.i + 1),
kept AS (SELECT block, row, list_contains(kept, row) AS kept FROM fold)"""
#: A telemetry fact for each event.
_FACTS = """facts AS (SELECT *, greatest(raw_tokens - post_tokens, 0) AS token_savings,
  round(100 * greatest(raw_tokens - post_tokens, 0) / greatest(raw_tokens, 1), 2) AS pct_saved,
  round(greatest(raw_tokens - post_tokens, 0) / 1e6 * CASE model WHEN 'gpt-4o-mini' THEN 5.0 WHEN 'gpt-4-turbo' THEN 10.0 WHEN 'claude-3-5-haiku' THEN 3.0 ELSE 5.0 END, 6) AS cost_usd_saved
  FROM (SELECT event_id AS request_id, ts, CASE event_type WHEN 'view' THEN '/v1/chat/completions' WHEN 'click' THEN '/rag/compress' WHEN 'purchase' THEN '/chat' ELSE '/compose' END AS endpoint,
    CASE user_id % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4-turbo' WHEN 2 THEN 'claude-3-5-haiku' ELSE 'other' END AS model, CAST(user_id AS VARCHAR) AS session_id,
    200 + k AS raw_tokens, 200 + k - (k % 7 + k % 13) AS post_tokens, k % 7 AS s_structural, k % 13 AS s_dedup, CASE WHEN k % 13 > 0 THEN 'lossy' ELSE 'lossless' END AS compression_mode,
    round(1 - (k % 10) / 20, 4) AS confidence_score, round(value, 3) AS overhead_ms, CASE WHEN k % 5 = 0 THEN 0.0 ELSE value * 10 END AS llm_latency_ms
    FROM (SELECT *, CAST(props::JSON ->> '$.k' AS BIGINT) AS k FROM events)))"""


_NOTE_TURNS = "turns AS (SELECT CAST(floor(doc_id / 10) AS BIGINT) AS session_id, doc_id % 10 AS turn_id, 'user' AS role, coalesce(text, '') AS content FROM documents)"
#: A word with a letter beyond ASCII can be part of a user's name only: elsewhere it is one character that no pattern takes.
_ENTITIES = r"""@OUT_c AS (SELECT session_id, turn_id, content, regexp_replace(regexp_replace(content, '[\x{85}\p{Z}]', ' ', 'g'), '[^\x00-\x7F\p{L}\p{M}\p{N}]', chr(4), 'g') AS u FROM @SRC),
@OUT_t AS (SELECT session_id, turn_id, content, regexp_replace(u, '[0-9A-Za-z_]*[^\x00-\x7F][0-9A-Za-z_\x{80}-\x{10FFFF}]*', chr(2), 'g') AS p, regexp_replace(u, '([^\x00-\x7F])', '\1zqz', 'g') AS m FROM @OUT_c),
@OUT_r AS (SELECT session_id, turn_id, unnest([
  {'t': 'file', 'k': 0, 'l': regexp_extract_all(p, '\b[A-Za-z0-9][A-Za-z0-9_\-]{1,64}\.[A-Za-z][A-Za-z0-9]{0,5}\b')},
  {'t': 'function', 'k': 1, 'l': regexp_extract_all(p, '\b[a-z_][a-zA-Z0-9_]*\s*\(')},
  {'t': 'module', 'k': 2, 'l': regexp_extract_all(p, '(?i)\b([A-Za-z][A-Za-z0-9_\- ]{2,})\s+module\b', 1)},
  {'t': 'class', 'k': 3, 'l': regexp_extract_all(p, '\b[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\b')},
  {'t': 'symbol', 'k': 4, 'l': regexp_extract_all(p, '\b[a-z][a-z0-9]+_[a-z0-9_]+\b')},
  {'t': 'user', 'k': 5, 'l': list_transform(regexp_extract_all(m, '(?i)\b(?:user|username|@[\p{L}\p{M}\p{N}_]+|I am|my name is)\s+([A-Za-z][\p{L}\p{M}\p{N}_]*)', 1), lambda x: replace(x, 'zqz', ''))},
  {'t': 'task', 'k': 6, 'l': regexp_extract_all(p, '(?i)\b(?:task|ticket|issue|bug|pr|story)\s*[#:]?\s*\d+')},
  {'t': 'variable', 'k': 7, 'l': regexp_extract_all(p, '\b[A-Z][A-Z0-9_]{2,}\b')},
  {'t': 'url', 'k': 8, 'l': regexp_extract_all(content, 'https?://\S+')}]) AS e FROM @OUT_t),
@OUT_n AS (SELECT session_id, turn_id, e.t AS etype, e.k AS ord, unnest(e.l) AS raw, generate_subscripts(e.l, 1) AS i FROM @OUT_r),
@OUT_p AS (SELECT *, list_filter(list_transform(list_filter(list_transform(regexp_extract_all(regexp_replace(raw, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)),
  lambda x: x NOT IN (@STOP)), lambda x: CASE WHEN length(x) >= 8 THEN substring(x, 1, 4) ELSE x END), lambda x: length(x) >= 2) AS parts FROM @OUT_n),
@OUT_d AS (SELECT session_id, turn_id, etype, ord, CASE WHEN etype = 'url' THEN regexp_replace(raw, '^\s+|\s+$', '', 'g') WHEN len(parts) > 0 THEN array_to_string(parts, '_') ELSE lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')) END AS name, min(i) AS i FROM @OUT_p GROUP BY ALL),
@OUT AS (SELECT session_id, turn_id, etype, CAST(ord AS INTEGER) AS ord, CAST(row_number() OVER (PARTITION BY session_id, turn_id, etype ORDER BY i) - 1 AS INTEGER) AS pos, name FROM @OUT_d WHERE name <> '')"""


def _entity_rows(source: str, out: str) -> str:
    """SQL of `out`: session_id, turn_id, etype, ord, pos, name of the entities of source (session_id, turn_id, content)."""
    return _ENTITIES.replace("@SRC", source).replace("@OUT", out).replace("@STOP", ", ".join(f"'{w}'" for w in (*entities.GENERIC, *entities.EXTENSIONS)))


#: The entities of each turn and of each session's query, and what they share.
_ASKED = f"""asking AS (SELECT session_id, 0 AS turn_id, query AS content FROM parts), {_entity_rows("turns", "named")}, {_entity_rows("asking", "wanted")},
asked AS (SELECT session_id, list(DISTINCT name) AS names FROM wanted GROUP BY session_id),
told AS (SELECT session_id, turn_id, list(DISTINCT name) AS names FROM named GROUP BY session_id, turn_id),
shared AS (SELECT h.session_id, h.turn_id, h.role, h.content, h.query, coalesce(a.names, []) AS asked, list_intersect(coalesce(a.names, []), coalesce(t.names, [])) AS hit
  FROM history h LEFT JOIN asked a USING (session_id) LEFT JOIN told t ON t.session_id = h.session_id AND t.turn_id = h.turn_id),
first_named AS (SELECT session_id, name, min(turn_id) AS turn_id FROM (SELECT session_id, turn_id, unnest(hit) AS name FROM shared) GROUP BY session_id, name)"""
_ENTITY_LINE = """first_at AS (SELECT session_id, etype, name, min((turn_id, ord, pos)) AS place FROM @EDGES GROUP BY ALL),
type_line AS (SELECT session_id, min(place) AS place, etype || 's: ' || array_to_string((list(name ORDER BY place))[1:8], ', ') AS line FROM first_at GROUP BY session_id, etype),
entity_lines AS (SELECT session_id, '[Entities] ' || string_agg(line, '; ' ORDER BY place) AS entity_line FROM type_line GROUP BY session_id)"""


def _word_sets(a: str, b: str) -> str:
    return f"list_distinct({_WORDS.format(a)}) AS wa, list_distinct({_WORDS.format(b)}) AS wb"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.from_table(table(spark, sf_dir, "conversations"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = turns(spark, sf_dir)
    return chat.history(every, chat.split(every))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A telemetry fact for each event."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    pick = lambda c, table_, other: F.coalesce(*[F.when(c == k, v) for k, v in table_.items()], F.lit(other))
    zero = F.map_from_arrays(F.array(F.lit("structural"), F.lit("deduplication")), F.array(F.col("k") % 7, F.col("k") % 13))
    base = e.select(
        F.col("event_id").alias("request_id"), "ts", pick(F.col("event_type"), {"view": "/v1/chat/completions", "click": "/rag/compress", "purchase": "/chat"}, "/compose").alias("endpoint"),
        pick(F.col("user_id") % 4, {0: "gpt-4o-mini", 1: "gpt-4-turbo", 2: "claude-3-5-haiku"}, "other").alias("model"), F.col("user_id").cast("string").alias("session_id"),
        (200 + F.col("k")).alias("raw_tokens"), (200 + F.col("k") - (F.col("k") % 7 + F.col("k") % 13)).alias("post_tokens"), zero.alias("savings_by_stage"),
        F.when(F.col("k") % 13 > 0, "lossy").otherwise("lossless").alias("compression_mode"), (1 - (F.col("k") % 10) / 20).alias("confidence_score"), F.col("value").alias("overhead_ms"),
        F.when(F.col("k") % 5 == 0, 0.0).otherwise(F.col("value") * 10).alias("llm_latency_ms"),
    )
    return telemetry.recorded(base)


# --- sources and rendering -------------------------------------------------------------------


@query(f"WITH {_TURNS}, {_SPLIT} SELECT session_id, system, query, query_turn FROM parts")
def split_conversation(spark, sf_dir):
    return chat.split(turns(spark, sf_dir)).select("session_id", "system", "query", "query_turn")


@query(f"""WITH {_TURNS}, {_SPLIT}, ends AS (SELECT session_id, arg_max(role, turn_id) AS role, max(turn_id) AS turn_id, arg_max(content, turn_id) AS content FROM turns
WHERE NOT (role = 'system' AND turn_id = 0) GROUP BY session_id)
SELECT p.session_id, p.system, CASE WHEN e.role = 'user' THEN e.content ELSE '' END AS query, CASE WHEN e.role = 'user' THEN e.turn_id END AS query_turn FROM parts p LEFT JOIN ends e USING (session_id)""")
def split_request(spark, sf_dir):
    return chat.split(turns(spark, sf_dir), "last_turn").select("session_id", "system", "query", "query_turn")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || '[image]' END AS content FROM conversations")
def flatten_content(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.to_json(F.array(block("text", F.col("text")), block("image_url", F.lit(None).cast("string")), block("text", F.lit(""))))
    raw = rows.withColumn("raw", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(blocks))
    return raw.select("conv_id", "turn", chat.flatten_content(F.col("raw")).alias("content"))


@query("""SELECT item_id AS session_id, CAST(k AS BIGINT) AS turn_id, CASE WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
CASE WHEN k % 2 = 0 THEN 'Can you explain ' || text || '?' ELSE 'Here is how ' || text || ' works, step by step.' END AS content
FROM benchmark, (SELECT unnest(range(20)) AS k)""")
def synthetic_history(spark, sf_dir):
    return chat.synthetic(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("session_id"), F.col("text").alias("topic")), 20)


@query(f"""WITH {_FACTS}, listed AS (SELECT * FROM (VALUES {", ".join(f"('{m}', 'model', '{o}')" for m, o in tokens.LISTED_MODELS)}) AS t(id, object, owned_by))
SELECT id, object, owned_by, count(f.request_id) AS requests FROM listed l LEFT JOIN facts f ON f.model = l.id GROUP BY ALL""")
def models_list(spark, sf_dir):
    used = facts(spark, sf_dir).groupBy(F.col("model").alias("id")).agg(F.count("*").alias("requests"))
    return chat.models(spark).join(used, "id", "left").fillna(0, ["requests"])


@query(rf"""WITH {_TURNS}, {_SPLIT} SELECT p.session_id, {_TOK.format("p.system")} + {_TOK.format("p.query")} + CAST(coalesce(sum({_TOK.format("h.content")}), 0) AS BIGINT) AS prompt_tokens
FROM parts p LEFT JOIN history h ON h.session_id = p.session_id GROUP BY p.session_id, p.system, p.query""")
def dry_run_tokens(spark, sf_dir):
    every = turns(spark, sf_dir)
    parts = chat.split(every)
    lists = chat.history(every, parts).groupBy("session_id").agg(F.collect_list("content").alias("contents"))
    joined = parts.join(lists, "session_id", "left").withColumn("contents", F.coalesce("contents", F.array().cast("array<string>")))
    return joined.select("session_id", chat.dry_run(F.col("system"), F.col("contents"), F.col("query")).alias("prompt_tokens"))


@query(f"""WITH {_TURNS}, {_SPLIT}, said AS (SELECT session_id, list('{{"role":' || to_json(role) || ',"content":' || to_json(content) || '}}' ORDER BY turn_id) AS l FROM history GROUP BY session_id),
p AS (SELECT session_id, system, list_concat(coalesce(l, []), CASE WHEN query <> '' THEN ['{{"role":"user","content":' || to_json(query) || '}}'] ELSE [] END) AS l FROM parts LEFT JOIN said USING (session_id))
SELECT session_id, CASE WHEN session_id % 2 = 0 THEN '{{"model":"gpt-4o","messages":[' || array_to_string(list_concat(CASE WHEN system <> '' THEN ['{{"role":"system","content":' || to_json(system) || '}}'] ELSE [] END, l), ',') || '],"temperature":0.7}}'
ELSE '{{"model":"claude-3-5-sonnet","max_tokens":4096,"temperature":0.7' || CASE WHEN system <> '' THEN ',"system":[{{"type":"text","text":' || to_json(system) || CASE WHEN session_id % 3 = 0 THEN ',"cache_control":{{"type":"ephemeral"}}' ELSE '' END || '}}]' ELSE '' END || ',"messages":[' || array_to_string(l, ',') || ']}}' END AS payload FROM p""")
def provider_payload(spark, sf_dir):
    every = turns(spark, sf_dir)
    parts = chat.split(every)
    lists = chat.history(every, parts).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "role", "content"))).alias("turns"))
    model = F.when(F.col("session_id") % 2 == 0, "gpt-4o").otherwise("claude-3-5-sonnet")
    made = chat.payload(F.col("system"), F.lit(""), F.coalesce("turns", F.array().cast("array<struct<turn_id:bigint,role:string,content:string>>")), F.col("query"), model, F.col("session_id") % 3 == 0, F.lit(0.7), F.lit(None).cast("int"))
    return parts.join(lists, "session_id", "left").select("session_id", made.alias("payload"))


@query("""SELECT item_id AS request_id, CAST(k AS INTEGER) AS seq, 'data: ' || CASE k WHEN 0 THEN '{"object":"chat.completion.chunk","delta":{"role":"assistant"}}' WHEN 1 THEN '{"object":"chat.completion.chunk","delta":{"content":' || to_json(text) || '}}'
WHEN 2 THEN '{"object":"chat.completion.chunk","finish_reason":"stop"}' ELSE '[DONE]' END || chr(10) || chr(10) AS data FROM benchmark, (SELECT unnest([0, 1, 2, 3]) AS k)""")
def response_stream(spark, sf_dir):
    return chat.event_stream(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), "text"))


@query(f"""WITH {_TURNS}, {_SPLIT} SELECT p.session_id, regexp_replace(array_to_string(list_concat(CASE WHEN p.system <> '' THEN ['[System]' || chr(10) || p.system] ELSE [] END,
coalesce(list('[' || h.role || '] ' || h.content ORDER BY h.turn_id) FILTER (h.turn_id IS NOT NULL), [])), chr(10)), '^\\s+|\\s+$', '', 'g') AS context
FROM parts p LEFT JOIN history h ON h.session_id = p.session_id GROUP BY p.session_id, p.system""")
def context_render(spark, sf_dir):
    every = turns(spark, sf_dir)
    parts = chat.split(every)
    lists = chat.history(every, parts).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "role", "content"))).alias("turns"))
    none = F.array().cast("array<struct<turn_id:bigint,role:string,content:string>>")
    return parts.join(lists, "session_id", "left").select("session_id", T.rendered_context(F.col("system"), F.lit(""), F.coalesce("turns", none)).alias("context"))


@query(f"""WITH {_TURNS}, last4 AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) <= 4)
SELECT session_id, 'Summary: so far' || chr(10) || 'Recent:' || chr(10) || string_agg(upper(role[1]) || role[2:] || ': ' || content, chr(10) ORDER BY turn_id) AS context FROM last4 GROUP BY session_id""")
def chat_render(spark, sf_dir):
    lists = turns(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "role", "content"))).alias("turns"))
    return lists.select("session_id", T.rendered_chat(F.lit("so far"), F.col("turns"), 4).alias("context"))


@query()
def chat_sessions(spark, sf_dir):
    return session.chat_turns(turns(spark, sf_dir), recent=2, most=30)


# --- text and tokens -------------------------------------------------------------------------


@query(f"SELECT doc_id, {_TOK.format('text')} AS n_tokens FROM documents")
def token_count_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.count(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 3.5 + 0.5) AS BIGINT)) END AS n_tokens FROM documents")
def token_count_claude(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.count(F.col("text"), "claude-3-opus").alias("n_tokens"))


@query(f"WITH {_TURNS} SELECT session_id, CAST(3 + sum(4 + {_TOK.format('content')} + {_TOK.format('role')}) AS BIGINT) AS n_tokens FROM turns GROUP BY session_id")
def message_list_tokens(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("session_id").agg((F.sum(tokens.of_turn(F.col("role"), F.col("content"))) + tokens.LIST_TOKENS).alias("n_tokens"))


@query(f"SELECT doc_id, len({_WORDS.format('text')}) AS n_words, len(list_distinct({_WORDS.format('text')})) AS n_distinct FROM documents")
def word_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.word_list(F.col("text"))).cast("long").alias("n_words"), F.size(T.word_set(F.col("text"))).cast("long").alias("n_distinct"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(l, lambda x, i: {'x': x, 'keep': i = 1 OR x <> l[i - 1]}), lambda p: p.keep), lambda p: p.x), chr(10)) AS normalized
FROM (SELECT doc_id, list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '\s+$', '')) AS l FROM documents)""")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_prompt(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, {_WS.format('text')} AS clean FROM documents")
def whitespace_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cleanup_whitespace(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {_PUNCT.format('text')} AS clean FROM documents")
def punctuation_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cleanup_punctuation(F.col("text")).alias("clean"))


@query(f"WITH {_TURNS} SELECT session_id, turn_id, {_CLEAN} AS clean, greatest(0, length(content) - length({_CLEAN})) AS chars_saved FROM turns")
def structural_compress(spark, sf_dir):
    clean = structural.compress(F.col("content"))
    return turns(spark, sf_dir).withColumn("clean", clean).select("session_id", "turn_id", "clean", F.greatest(F.lit(0), F.length("content") - F.length("clean")).cast("long").alias("chars_saved"))


@query()
def json_spans(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", structural.spans(F.col("html")).alias("spans"))
    return found.select("page_id", F.size("spans").alias("n_spans"), "spans")


@query()
def json_compress(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n_chars"), F.length(structural.compress(F.col("html"))).alias("n_clean"))


@query()
def token_count_bpe(spark, sf_dir):
    import public_tokenizers

    return table(spark, sf_dir, "documents").select("doc_id", tokens.count(F.col("text"), "gpt-4o", tokens.bpe_counter(public_tokenizers.path("byte_bpe_50k.json"))).alias("n_tokens"))


@query("SELECT user_id AS request_id, max(CASE WHEN user_id % 3 = 0 THEN true WHEN user_id % 3 = 1 THEN user_id % 2 = 0 ELSE user_id % 5 = 0 END) AS authorised FROM events GROUP BY user_id")
def auth_check(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id")).distinct()
    bearer = F.when(F.col("request_id") % 3 == 0, " bearer  k-1 ").when(F.col("request_id") % 3 == 1, F.when(F.col("request_id") % 2 == 0, "Bearer k-1").otherwise("Bearer other"))
    key = F.when(F.col("request_id") % 5 == 0, " k-1 ").when(F.col("request_id") % 3 == 1, "k-1")
    return users.select("request_id", chat.authorised(bearer, key, "k-1").alias("authorised"))


#: Models that requests name: those of the facts, and others by the event's type and user.
_NAMED = f"WITH {_FACTS}, named AS (SELECT request_id, CASE session_id::BIGINT % 5 WHEN 0 THEN model WHEN 1 THEN 'o1-mini' WHEN 2 THEN 'Claude-2.1-' || endpoint WHEN 3 THEN upper(model) || '-2024' ELSE 'gpt-5' END AS model FROM facts)"


def _named(spark, sf_dir) -> DataFrame:
    user = F.col("session_id").cast("long") % 5
    name = F.when(user == 0, F.col("model")).when(user == 1, "o1-mini").when(user == 2, F.concat(F.lit("Claude-2.1-"), "endpoint")).when(user == 3, F.concat(F.upper("model"), F.lit("-2024"))).otherwise("gpt-5")
    return facts(spark, sf_dir).select("request_id", name.alias("model"))


@query(f"""{_NAMED}, registry AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{f}', '{e}', {w})" for k, (f, e, w) in tokens.MODELS.items())}) AS r(key, family, encoding, ctx_window))
SELECT request_id, coalesce(arg_max(family, length(key)), 'openai') AS family, coalesce(arg_max(encoding, length(key)), 'cl100k_base') AS encoding, CAST(coalesce(arg_max(ctx_window, length(key)), 128000) AS INTEGER) AS ctx_window
FROM named LEFT JOIN registry ON contains(lower(model), key) GROUP BY request_id""")
def model_detect(spark, sf_dir):
    return _named(spark, sf_dir).withColumn("d", tokens.detect(F.col("model"))).select("request_id", "d.family", "d.encoding", "d.ctx_window")


@query(f"{_NAMED} SELECT request_id, CAST(CASE " + " ".join(f"WHEN contains(lower(model), '{k}') THEN {p}" for k, p in tokens.INPUT_PRICES.items()) + " ELSE 5.0 END AS DOUBLE) AS usd_per_million FROM named")
def price_lookup(spark, sf_dir):
    return _named(spark, sf_dir).select("request_id", tokens.input_price(F.col("model")).alias("usd_per_million"))


@query(f"""WITH {_FACTS} SELECT request_id, round(raw_tokens / 1000 * CASE model WHEN 'gpt-4-turbo' THEN 30.0 WHEN 'claude-3-5-haiku' THEN 3.0 ELSE 5.0 END + post_tokens / 1000 * CASE model WHEN 'gpt-4-turbo' THEN 60.0 ELSE 15.0 END, 6) AS cost_usd FROM facts""")
def legacy_cost(spark, sf_dir):
    return facts(spark, sf_dir).select("request_id", F.round(tokens.chat_cost(F.col("model"), F.col("raw_tokens"), F.col("post_tokens")), 6).alias("cost_usd"))


@query(f"""WITH {_TURNS}, p AS (SELECT session_id, CAST(sum({_TOK.format("content")}) FILTER (role <> 'assistant') AS BIGINT) AS input_tokens, CAST(coalesce(sum({_TOK.format("content")}) FILTER (role = 'assistant'), 0) AS BIGINT) AS output_tokens FROM turns GROUP BY session_id)
SELECT session_id, coalesce(input_tokens, 0) AS input_tokens, output_tokens, coalesce(input_tokens, 0) + output_tokens AS total_tokens, round(coalesce(input_tokens, 0) / 1000 * 5.0 + output_tokens / 1000 * 15.0, 6) AS cost_usd FROM p""")
def profile(spark, sf_dir):
    n, said = tokens.count(F.col("content")), F.col("role") == "assistant"
    sums = turns(spark, sf_dir).groupBy("session_id").agg(F.coalesce(F.sum(F.when(~said, n)), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(F.when(said, n)), F.lit(0)).alias("output_tokens"))
    return sums.select("*", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.round(tokens.chat_cost(F.lit("gpt-4o"), F.col("input_tokens"), F.col("output_tokens")), 6).alias("cost_usd"))


@query(rf"""WITH n AS (SELECT item_id, text, {_WS.format("text")} AS normalized, CASE item_id % 4 WHEN 0 THEN 'Respond with concise bullet points. Keep it under 6!' WHEN 1 THEN 'Be Concise!' WHEN 2 THEN 'Return code only in a single block, no prose.' END AS instruction FROM benchmark)
SELECT item_id, optimized_prompt, {_TOK.format("text")} AS original_tokens, {_TOK.format("optimized_prompt")} AS optimized_tokens, greatest({_TOK.format("text")} - {_TOK.format("optimized_prompt")}, 0) AS token_savings,
round({_TOK.format("optimized_prompt")} / 1000 * 5.0, 6) AS cost_usd, sha256(normalized || '||' || coalesce(instruction, '') || '||gpt-4o') AS cache_key
FROM (SELECT *, CASE WHEN instruction IS NULL THEN normalized ELSE instruction || chr(10) || chr(10) || normalized END AS optimized_prompt FROM n)""")
def compose_prompt(spark, sf_dir):
    mode = F.when(F.col("item_id") % 4 == 0, "bullets").when(F.col("item_id") % 4 == 1, "plain").when(F.col("item_id") % 4 == 2, "code")
    base = table(spark, sf_dir, "benchmark").withColumn("normalized", T.normalize_prompt(F.col("text"))).withColumn("instruction", T.output_instruction(mode))
    made = base.withColumn("optimized_prompt", F.when(F.col("instruction").isNull(), F.col("normalized")).otherwise(F.concat("instruction", F.lit("\n\n"), "normalized")))
    before, after = tokens.count(F.col("text")), tokens.count(F.col("optimized_prompt"))
    return made.select("item_id", "optimized_prompt", before.alias("original_tokens"), after.alias("optimized_tokens"), F.greatest(before - after, F.lit(0)).alias("token_savings"), F.round(tokens.chat_cost(F.lit("gpt-4o"), after, F.lit(0)), 6).alias("cost_usd"), T.digest_key(F.col("normalized"), F.col("instruction"), F.lit("gpt-4o")).alias("cache_key"))


@query(f"""WITH {_TURNS}, {_SPLIT} SELECT p.session_id, 'cache:prefix:gpt-4o:' || sha256(p.system) AS prefix_key,
'cache:turn:gpt-4o:' || sha256(array_to_string(list_concat([p.system], coalesce(list(h.content ORDER BY h.turn_id) FILTER (h.turn_id IS NOT NULL), []), [p.query]), '||')) AS turn_key
FROM parts p LEFT JOIN history h ON h.session_id = p.session_id GROUP BY p.session_id, p.system, p.query""")
def sha_keys(spark, sf_dir):
    every = turns(spark, sf_dir)
    parts = chat.split(every)
    lists = chat.history(every, parts).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "content"))), lambda x: x["content"]).alias("texts"))
    texts = F.coalesce("texts", F.array().cast("array<string>"))
    return parts.join(lists, "session_id", "left").select("session_id", T.prefix_key(F.col("system"), F.lit("gpt-4o")).alias("prefix_key"), T.turn_key(F.col("system"), texts, F.col("query"), F.lit("gpt-4o")).alias("turn_key"))


def _loss_sql(content: str) -> str:
    tiers = [(f"regexp_extract({content}, '(?i)\\b({'|'.join(p)})\\b', 1)".replace("didn't", "didn''t"), c) for p, c in T.LOSS_PHRASES]
    phrase = "CASE " + " ".join(f"WHEN {t} <> '' THEN {t}" for t, _ in tiers) + " ELSE '' END"
    return f"{phrase} AS phrase, CAST(CASE " + " ".join(f"WHEN {t} <> '' THEN {c}" for t, c in tiers) + " ELSE 0 END AS DOUBLE) AS confidence"


#: Test conversations hold no complaint, so each third one gets a sentence put before it.
_COMPLAINT = "CASE WHEN turn_id % 3 = 0 THEN 'As I mentioned, ' WHEN turn_id % 3 = 1 AND session_id % 2 = 0 THEN 'You lost track. ' ELSE '' END || content"


def _complaining(rows: DataFrame) -> DataFrame:
    said = F.when(F.col("turn_id") % 3 == 0, "As I mentioned, ").when((F.col("turn_id") % 3 == 1) & (F.col("session_id") % 2 == 0), "You lost track. ").otherwise("")
    return rows.withColumn("content", F.concat(said, F.col("content")))


@query(f"WITH {_TURNS}, said AS (SELECT session_id, turn_id, {_COMPLAINT} AS content FROM turns) SELECT session_id, turn_id, {_loss_sql('content')} FROM said WHERE phrase <> ''")
def context_loss_detect(spark, sf_dir):
    return telemetry.context_losses(_complaining(turns(spark, sf_dir))).select("session_id", "turn_id", "phrase", "confidence")


# --- similarity, removal, relevance ----------------------------------------------------------


def _rows(spark, sf_dir) -> DataFrame:
    return turns(spark, sf_dir)


@query(f"WITH {_TURNS}, rows_in AS (SELECT * FROM turns), {_VECTORS} SELECT block AS session_id, row AS turn_id, term, round(weight, 6) AS weight FROM weighed")
def tfidf_vectors(spark, sf_dir):
    return dedup.tfidf(_rows(spark, sf_dir), "session_id", "turn_id", "content").select(F.col("block").alias("session_id"), F.col("row").alias("turn_id"), "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_TURNS}, rows_in AS (SELECT * FROM turns), {_VECTORS} SELECT block AS session_id, a, b, round(similarity, 6) AS similarity FROM pairs")
def tfidf_pairs(spark, sf_dir):
    return dedup.tfidf_pairs(dedup.tfidf(_rows(spark, sf_dir), "session_id", "turn_id", "content")).select(F.col("block").alias("session_id"), "a", "b", F.round("similarity", 6).alias("similarity"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT x.label, x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))), 6) AS similarity FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id""")
def dense_cosine_pairs(spark, sf_dir):
    return dedup.dense_pairs(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", digits=6).select(F.col("block").alias("label"), "a", "b", "similarity")


@query(f"WITH RECURSIVE {_TURNS}, rows_in AS (SELECT * FROM turns), {_VECTORS}, {_GREEDY.format(0.3)} SELECT block AS session_id, row AS turn_id, kept FROM kept")
def dedup_conversations(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return dedup.deduplicated(rows, "session_id", "turn_id", "content", 0.3, dedup.large(rows, "session_id")).select("session_id", "turn_id", "kept")


@query(f"WITH {_TURNS}, rows_in AS (SELECT role AS session_id, session_id * 1000 + turn_id AS turn_id, content FROM turns), {_VECTORS} SELECT block AS role, a, b, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.8")
def similarity_join(spark, sf_dir):
    rows = turns(spark, sf_dir).select("role", (F.col("session_id") * 1000 + F.col("turn_id")).alias("turn_no"), "content")
    return largeblocks.pairs(rows, "role", "turn_no", "content", 0.8).select(F.col("block").alias("role"), "a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH RECURSIVE {_TURNS}, rows_in AS (SELECT role AS session_id, session_id * 1000 + turn_id AS turn_id, content FROM turns), {_VECTORS}, {_GREEDY.format(0.8)} SELECT block AS role, row AS turn_no, kept FROM kept")
def dedup_by_role(spark, sf_dir):
    rows = turns(spark, sf_dir).select("role", (F.col("session_id") * 1000 + F.col("turn_id")).alias("turn_no"), "content")
    return dedup.deduplicated(rows, "role", "turn_no", "content", 0.8, dedup.large(rows, "role", 16)).select("role", "turn_no", "kept")


@query(f"WITH {_TURNS}, {_SPLIT}, s AS (SELECT session_id, turn_id, {_word_sets('content', 'query')} FROM history) SELECT session_id, turn_id, round({_OCHIAI.format('wa', 'wb')}, 4) AS score FROM s")
def score_turns(spark, sf_dir):
    return relevance.scored(history(spark, sf_dir)).select("session_id", "turn_id", "score")


@query(f"""WITH {_TURNS}, {_SPLIT}, s AS (SELECT session_id, turn_id, {_word_sets("content", "query")} FROM history), r AS (SELECT session_id, turn_id, round({_OCHIAI.format("wa", "wb")}, 4) AS score FROM s)
SELECT session_id, count(*) AS turns, count(*) FILTER (score >= 0.15) AS kept, round(coalesce(1 - max(score) FILTER (score < 0.15), 1.0), 4) AS confidence, round(coalesce(min(score) FILTER (score < 0.15), 1.0), 4) AS standalone_confidence FROM r GROUP BY session_id""")
def prune_turns(spark, sf_dir):
    kept = relevance.pruned(relevance.scored(history(spark, sf_dir)))
    return kept.groupBy("session_id").agg(F.count("*").alias("turns"), F.count(F.when(F.col("kept_rel"), 1)).alias("kept"), relevance.prune_confidence().alias("confidence"), relevance.prune_confidence(standalone=True).alias("standalone_confidence"))


def _chunks(spark, sf_dir) -> DataFrame:
    """Documents as chunks of their source, with a benchmark item as the source's question."""
    asked = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), "item_id").alias("source"), F.col("text").alias("query"))
    return relevance.scored(table(spark, sf_dir, "documents").join(asked, "source"), "text", "query")


_CHUNKS = f"""c AS (SELECT d.doc_id, d.source, d.text, {_word_sets("d.text", "b.text")} FROM documents d JOIN benchmark b ON d.source = 'src' || b.item_id),
scored AS (SELECT doc_id, source, round({_OCHIAI.format("wa", "wb")}, 4) AS score, {_TOK.format("text")} AS tokens FROM c)"""


@query(f"WITH {_CHUNKS} SELECT source, doc_id, score, tokens FROM scored")
def rag_scores(spark, sf_dir):
    return _chunks(spark, sf_dir).select("source", "doc_id", "score", tokens.words(F.col("text")).alias("tokens"))


@query(f"""WITH RECURSIVE {_CHUNKS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM scored),
walk AS (SELECT source, rank, doc_id, score, tokens, tokens <= 4000 AS kept, CASE WHEN tokens <= 4000 THEN tokens ELSE 0 END AS used FROM ranked WHERE rank = 1
  UNION ALL SELECT r.source, r.rank, r.doc_id, r.score, r.tokens, w.used + r.tokens <= 4000, CASE WHEN w.used + r.tokens <= 4000 THEN w.used + r.tokens ELSE w.used END FROM walk w JOIN ranked r ON r.source = w.source AND r.rank = w.rank + 1)
SELECT source, doc_id, CAST(rank AS INTEGER) AS rank, score, tokens, kept FROM walk""")
def rag_pack(spark, sf_dir):
    packed = relevance.packed(_chunks(spark, sf_dir), "source", "doc_id", "text")
    return packed.select(F.col("query_id").alias("source"), F.col("chunk_id").alias("doc_id"), "rank", "score", "tokens", "kept")


@query(f"""WITH {_TURNS}, last3 AS (SELECT session_id, string_agg(content, ' ' ORDER BY turn_id) AS t FROM (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) <= 3) GROUP BY session_id),
whole AS (SELECT session_id, string_agg(content, ' ' ORDER BY turn_id) AS t FROM turns GROUP BY session_id), s AS (SELECT session_id, {_word_sets("w.t", "l.t")} FROM whole w JOIN last3 l USING (session_id))
SELECT session_id, round(1 - len(list_intersect(wa, wb)) / greatest(1, len(list_distinct(list_concat(wa, wb)))), 6) AS drift FROM s""")
def jaccard_drift(spark, sf_dir):
    joined = lambda rows, name: rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "content"))), lambda x: x["content"]), " ").alias(name))
    every = turns(spark, sf_dir)
    both = joined(every, "a").join(joined(summary.windowed(every, 3).where("recent"), "b"), "session_id")
    return both.select("session_id", F.round(similarity.jaccard_distance(T.word_set(F.col("a")), T.word_set(F.col("b"))), 6).alias("drift"))


def _notes(spark, sf_dir) -> DataFrame:
    """Documents as sessions of ten turns: the test conversations name no entities."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.floor(F.col("doc_id") / 10).alias("session_id"), (F.col("doc_id") % 10).alias("turn_id"), F.lit("user").alias("role"), F.col("text").alias("content"))


# --- entities --------------------------------------------------------------------------------




@query(r"""WITH t AS (SELECT CAST(floor(doc_id / 10) AS BIGINT) AS session_id, doc_id % 10 AS turn_id, text AS content, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS u, regexp_replace(text, '[^\x00-\x7F]', 'q', 'g') AS q FROM documents)
SELECT session_id, turn_id, len(regexp_extract_all(u, '\b[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\b')) AS n_class, len(regexp_extract_all(q, '\b[A-Z][A-Z0-9_]{2,}\b')) AS n_variable, len(regexp_extract_all(content, 'https?://\S+')) AS n_url FROM t""")
def entity_raw_matches(spark, sf_dir):
    return _notes(spark, sf_dir).select("session_id", "turn_id", *[F.size(entities.raw(F.col("content"), k)).cast("long").alias(f"n_{k}") for k in ("class", "variable", "url")])


def _asked(spark, sf_dir) -> DataFrame:
    every = _notes(spark, sf_dir)
    return chat.history(every, chat.split(every))


@query(f"WITH {_NOTE_TURNS}, {_entity_rows('turns', 'named')} SELECT session_id, turn_id, etype, ord, pos, name FROM named")
def entity_edges(spark, sf_dir):
    return graph.edges(_notes(spark, sf_dir))


@query(f"WITH {_NOTE_TURNS}, {_entity_rows('turns', 'named')} SELECT session_id, etype, name, min(turn_id) AS first_seen_turn, max(turn_id) AS last_seen_turn, count(DISTINCT turn_id) AS mention_count FROM named GROUP BY ALL")
def entity_index(spark, sf_dir):
    return graph.index(graph.edges(_notes(spark, sf_dir)))


@query(f"""WITH {_NOTE_TURNS}, {_entity_rows('turns', 'named')}, f AS (SELECT session_id, etype, name, min((turn_id, ord, pos)) AS place FROM named GROUP BY ALL),
t AS (SELECT session_id, etype, CAST(to_json(list(name ORDER BY place)) AS VARCHAR) AS names FROM f GROUP BY ALL)
SELECT session_id, '{{' || string_agg('"' || etype || '":' || names, ',' ORDER BY etype) || '}}' AS entities FROM t GROUP BY session_id""")
def entity_snapshot(spark, sf_dir):
    return graph.snapshot(graph.edges(_notes(spark, sf_dir))).select("session_id", F.to_json("entities").alias("entities"))


@query()
def entity_resolution(spark, sf_dir):
    return graph.resolved(_notes(spark, sf_dir))


@query(f"WITH {_NOTE_TURNS}, {_SPLIT}, {_ASKED} SELECT session_id, turn_id, round(CASE WHEN len(asked) > 0 THEN len(hit) / len(asked) ELSE 0.0 END, 4) AS overlap FROM shared")
def entity_overlap(spark, sf_dir):
    h = _asked(spark, sf_dir)
    return h.select("session_id", "turn_id", F.round(similarity.share_of(entities.all_names(F.col("query")), entities.all_names(F.col("content"))), 4).alias("overlap"))


@query(f"WITH {_NOTE_TURNS}, {_SPLIT}, {_ASKED} SELECT session_id, turn_id FROM shared WHERE len(hit) > 0 AND len(hit) / len(asked) >= 0.1 UNION SELECT session_id, turn_id FROM first_named")
def load_bearing_turns(spark, sf_dir):
    every = _notes(spark, sf_dir)
    parts = chat.split(every)
    # a query's names are found once and not beside every turn, and a turn's names before its text would be shuffled
    asked = parts.select("session_id", F.explode(entities.all_names(F.col("query"))).alias("name"))
    named = every.select("session_id", "turn_id", "role", entities.all_names(F.col("content")).alias("names"), F.lit("").alias("content")).where(F.size("names") > 0)
    told = chat.history(named, parts.select("session_id", "query_turn", "system_turn")).select("session_id", "turn_id", F.explode("names").alias("name"))
    return relevance.load_bearing(told, asked)


@query(f"""WITH {_NOTE_TURNS}, {_entity_rows('turns', 'named')}, recent AS (SELECT session_id, turn_id FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) <= 3),
a AS (SELECT session_id, count(DISTINCT name) AS n FROM named GROUP BY ALL), b AS (SELECT session_id, count(DISTINCT name) AS n FROM named JOIN recent USING (session_id, turn_id) GROUP BY ALL)
SELECT session_id, round(CASE WHEN a.n > 0 THEN coalesce(b.n, 0) / a.n ELSE 1.0 END, 4) AS recall FROM (SELECT DISTINCT session_id FROM turns) LEFT JOIN a USING (session_id) LEFT JOIN b USING (session_id)""")
def entity_recall(spark, sf_dir):
    # a text's names are found once, before the window; its text isn't shuffled
    named = _notes(spark, sf_dir).select("session_id", "turn_id", entities.all_names(F.col("content")).alias("names"))
    told = lambda names: F.array_distinct(F.flatten(F.collect_list(names)))
    both = summary.windowed(named, 3).groupBy("session_id").agg(told(F.col("names")).alias("a"), told(F.when(F.col("recent"), F.col("names"))).alias("b"))
    return both.select("session_id", F.round(entities.recall(F.col("a"), F.col("b")), 4).alias("recall"))


@query(f"""WITH {_NOTE_TURNS}, {_SPLIT}, {_entity_rows('turns', 'named')}, s AS (SELECT session_id, turn_id, {_word_sets("content", "query")} FROM history), gone AS (SELECT session_id, turn_id FROM s WHERE round({_OCHIAI.format("wa", "wb")}, 4) < 0.15)
SELECT session_id, array_to_string(list_sort(list(DISTINCT name)), ',') AS entities FROM gone JOIN named USING (session_id, turn_id) GROUP BY session_id""")
def removed_entities(spark, sf_dir):
    pruned = relevance.pruned(relevance.scored(_asked(spark, sf_dir)))
    return graph.removed_names(pruned.where("not kept_rel"), "session_id", "content").select("session_id", F.array_join("entities", ",").alias("entities"))


@query(f"WITH {_NOTE_TURNS}, {_entity_rows('turns', 'named')}, {_ENTITY_LINE.replace('@EDGES', 'named')} SELECT session_id, entity_line FROM entity_lines")
def entity_line(spark, sf_dir):
    return summary.entity_line(graph.edges(_notes(spark, sf_dir)))


@query()
def graph_reload(spark, sf_dir):
    return graph.reloaded(graph.serialised(graph.resolved(_notes(spark, sf_dir)))).withColumn("aliases", F.array_join("aliases", ","))


@query("SELECT name, regexp_matches(name, '^[0-9]{1,3}([.][0-9]{1,3}){3}$') OR regexp_matches(name, '^[$]?[0-9]+([.][0-9]+)+$') OR regexp_matches(name, '^[A-Za-z]([.][A-Za-z])+[.]?$') OR regexp_matches(name, '^[vV]?[0-9]+([.][0-9]+){1,3}$') AS false_file FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM documents UNION SELECT unnest(['10.0.0.1', '$3.50', 'U.S.', 'v1.2.3', 'main.py', '1.2.3.4.5']))")
def false_files(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ", -1)).alias("name")).union(spark.createDataFrame([(n,) for n in ("10.0.0.1", "$3.50", "U.S.", "v1.2.3", "main.py", "1.2.3.4.5")], "name string")).distinct()
    return words.select("name", entities.false_file(F.col("name")).alias("false_file"))


# --- summaries and plans ---------------------------------------------------------------------


_SENTENCES = rf"""sents AS (SELECT session_id, turn_id, i - 1 AS pos, regexp_replace(s, '^\s+|\s+$', '', 'g') AS sentence FROM (SELECT session_id, turn_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM
  (SELECT session_id, turn_id, string_split(regexp_replace(regexp_replace(content, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM turns)) WHERE {_TOK.format("s")} >= 4)"""


@query(f"WITH {_TURNS}, {_SENTENCES} SELECT session_id, turn_id, CAST(pos AS INTEGER) AS pos, sentence FROM sents")
def sentence_split(spark, sf_dir):
    return summary.sentences(turns(spark, sf_dir))


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_EXTRACT = rf"""{_SENTENCES}, sent_words AS (SELECT session_id, turn_id, pos, unnest(regexp_extract_all(lower(sentence), '\S+')) AS w FROM sents),
often AS (SELECT session_id, w, count(*) AS f FROM sent_words WHERE w NOT IN {_in(summary.STOPS)} AND length(w) > 3 GROUP BY ALL),
sent_scores AS (SELECT session_id, turn_id, pos, sum(coalesce(f, 0)) / count(*) AS score FROM sent_words LEFT JOIN often USING (session_id, w) GROUP BY ALL),
top_sents AS (SELECT s.* FROM sents s JOIN sent_scores USING (session_id, turn_id, pos) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, turn_id, pos) <= 4),
picked AS (SELECT session_id, string_agg(sentence, ' ' ORDER BY turn_id, pos) AS e FROM top_sents GROUP BY ALL), whole_text AS (SELECT session_id, string_agg(content, ' ' ORDER BY turn_id) AS e FROM turns GROUP BY ALL),
extracts AS (SELECT session_id, substring(coalesce(t.e, a.e), 1, 400) AS extract FROM whole_text a LEFT JOIN picked t USING (session_id))"""


@query(f"WITH {_TURNS}, {_EXTRACT} SELECT session_id, extract FROM extracts")
def extractive_summary(spark, sf_dir):
    return summary.extractive(turns(spark, sf_dir))


@query(rf"""WITH {_TURNS}, whole AS (SELECT session_id, string_agg(content, ' ' ORDER BY turn_id) AS t FROM turns WHERE content <> '' GROUP BY ALL),
u AS (SELECT session_id, t, regexp_replace(lower(t), '[^\x00-\x7F]', '_', 'g') AS l FROM whole), w AS (SELECT session_id, unnest(m) AS w, generate_subscripts(m, 1) AS p FROM (SELECT session_id, regexp_extract_all(l, '\b[a-z]{{3,}}\b') AS m FROM u)),
c AS (SELECT session_id, w, count(*) AS c, min(p) AS p FROM w WHERE w NOT IN {_in(summary.KEY_POINT_STOPS)} GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY c DESC, p) AS r FROM c QUALIFY r <= 12)
SELECT session_id, substring(coalesce('Key points: ' || string_agg(top.w, ', ' ORDER BY r), any_value(t)), 1, 500) AS summary FROM whole LEFT JOIN top USING (session_id) GROUP BY session_id""")
def key_points(spark, sf_dir):
    return summary.key_points(turns(spark, sf_dir))


@query(f"""WITH {_TURNS}, s AS (SELECT *, 4 + {_TOK.format("content")} + {_TOK.format("role")} AS tokens FROM turns)
SELECT session_id, turn_id, tokens, CAST(3 + sum(tokens) OVER (PARTITION BY session_id) AS BIGINT) AS session_tokens, sum(tokens) OVER (PARTITION BY session_id) + 3 > 300 AND row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) > 6 AS compress FROM s""")
def budget_trigger(spark, sf_dir):
    sized = turns(spark, sf_dir).withColumn("tokens", tokens.of_turn(F.col("role"), F.col("content")))
    return summary.over_budget(sized, 300).select("session_id", "turn_id", "tokens", "session_tokens", "compress")


@query(f"WITH {_TURNS} SELECT session_id, turn_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) <= 3 AS recent FROM turns")
def sliding_window(spark, sf_dir):
    return summary.windowed(turns(spark, sf_dir), 3).select("session_id", "turn_id", "recent")


@query(f"""WITH all_turns AS (SELECT conv_id AS session_id, turn AS turn_id, role, coalesce(text, '') AS content FROM conversations), turns AS (SELECT * FROM all_turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) > 3),
{_EXTRACT}, {_entity_rows('all_turns', 'named')}, {_ENTITY_LINE.replace('@EDGES', 'named')}
SELECT session_id, substring(array_to_string(list_filter([extract, coalesce(entity_line, '')], lambda x: x <> ''), ' | '), 1, 800) AS summary FROM extracts LEFT JOIN entity_lines USING (session_id)""")
def rolling_summary(spark, sf_dir):
    every = turns(spark, sf_dir)
    old = summary.windowed(every, 3).where("not recent")
    lines = summary.entity_line(graph.edges(every))
    return summary.extractive(old).join(lines, "session_id", "left").select("session_id", summary.merged(F.lit(""), F.col("extract"), F.col("entity_line")).alias("summary"))


@query(rf"""WITH {_TURNS}, placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM turns),
options AS (SELECT session_id, k, least(any_value(n), k) AS kept_turns, 'Summary: so far' || chr(10) || 'Recent:' || chr(10) || string_agg(upper(role[1]) || role[2:] || ': ' || content, chr(10) ORDER BY turn_id) AS context FROM placed JOIN (SELECT unnest([4, 3, 2, 1]) AS k) ON r <= k GROUP BY session_id, k)
SELECT session_id, CAST(kept_turns AS BIGINT) AS kept_turns, context FROM options WHERE {_TOK.format("context")} <= 200 OR k = 1 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY k DESC) = 1""")
def shrunk_window(spark, sf_dir):
    return summary.shrunk(turns(spark, sf_dir).withColumn("summary", F.lit("so far")), "summary", 200, 4)


_CLEAN_SYSTEM = _WS.format(_PUNCT.format("system"))
#: The plan of both modes at its default settings, the texts before and after, and the gate's verdict.
_GATED = f"""{_TURNS}, {_SPLIT}, rows_in AS (SELECT session_id, turn_id, role, content AS raw, {_CLEAN} AS content, query FROM history), {_VECTORS}, {_GREEDY.format(0.92)},
alike AS (SELECT p.block, p.b AS row, arg_min(p.similarity, p.a) AS similarity FROM pairs p JOIN kept k ON k.block = p.block AND k.row = p.a AND k.kept WHERE p.similarity >= 0.92 GROUP BY p.block, p.b),
asking AS (SELECT session_id, 0 AS turn_id, query AS content FROM parts), {_entity_rows("rows_in", "named")}, {_entity_rows("asking", "wanted")},
asked AS (SELECT session_id, list(DISTINCT name) AS names FROM wanted GROUP BY session_id), told AS (SELECT session_id, turn_id, list(DISTINCT name) AS names FROM named GROUP BY session_id, turn_id),
sized AS (SELECT r.*, k.kept AS kept_dedup, 4 + {_TOK.format("role")} + {_TOK.format("raw")} AS raw_tokens, 4 + {_TOK.format("role")} + {_TOK.format("content")} AS tokens, {_word_sets("content", "query")}, coalesce(a.names, []) AS asked, list_intersect(coalesce(a.names, []), coalesce(t.names, [])) AS hit
  FROM rows_in r JOIN kept k ON k.block = r.session_id AND k.row = r.turn_id LEFT JOIN asked a ON a.session_id = r.session_id LEFT JOIN told t ON t.session_id = r.session_id AND t.turn_id = r.turn_id),
first_named AS (SELECT DISTINCT session_id, turn_id FROM (SELECT session_id, name, min(turn_id) AS turn_id FROM (SELECT session_id, turn_id, unnest(hit) AS name FROM sized) GROUP BY session_id, name)),
scored AS (SELECT *, round(CASE WHEN len(asked) > 0 THEN least(1.0, {_OCHIAI.format("wa", "wb")} + 0.3 * len(hit) / len(asked)) ELSE {_OCHIAI.format("wa", "wb")} END, 4) AS score FROM sized),
judged AS (SELECT s.*, score >= 0.15 OR (len(hit) > 0 AND (len(hit) / len(asked) >= 0.1 OR f.turn_id IS NOT NULL)) AS kept_rel FROM scored s LEFT JOIN first_named f USING (session_id, turn_id)),
placed AS (SELECT *, sum(CASE WHEN kept_dedup AND kept_rel THEN tokens ELSE 0 END) OVER (PARTITION BY session_id) + 3 AS held, count(*) FILTER (kept_dedup AND kept_rel) OVER (PARTITION BY session_id ORDER BY turn_id DESC) AS after,
  sum(CASE WHEN kept_dedup THEN tokens ELSE 0 END) OVER (PARTITION BY session_id) + 3 AS held_safe, count(*) FILTER (kept_dedup) OVER (PARTITION BY session_id ORDER BY turn_id DESC) AS after_safe FROM judged),
staged AS (SELECT p.*, s.similarity, CASE WHEN NOT kept_dedup THEN 'deduplication' WHEN NOT kept_rel THEN 'relevance' WHEN held > 4000 AND after > 6 THEN 'summarization' END AS stage,
  CASE WHEN NOT kept_dedup THEN 'deduplication' WHEN held_safe > 4000 AND after_safe > 6 THEN 'summarization' END AS stage_safe FROM placed p LEFT JOIN alike s ON s.block = p.session_id AND s.row = p.turn_id),
old_turns AS (SELECT session_id, turn_id, content FROM staged WHERE stage = 'summarization'), {_EXTRACT.replace("FROM turns", "FROM old_turns")},
lines AS (SELECT session_id, list('[' || role || '] ' || raw ORDER BY turn_id) AS b, list('[' || role || '] ' || content ORDER BY turn_id) FILTER (stage IS NULL) AS a FROM staged GROUP BY session_id),
sides AS (SELECT p.session_id, regexp_replace(array_to_string(list_concat(CASE WHEN system <> '' THEN ['[System]' || chr(10) || system] ELSE [] END, coalesce(b, [])), chr(10)), '^\\s+|\\s+$', '', 'g') AS original,
  regexp_replace(array_to_string(list_concat(CASE WHEN {_CLEAN_SYSTEM} <> '' THEN ['[System]' || chr(10) || {_CLEAN_SYSTEM}] ELSE [] END, CASE WHEN coalesce(extract, '') <> '' THEN ['[Summary]' || chr(10) || substring(extract, 1, 800)] ELSE [] END, coalesce(a, [])), chr(10)), '^\\s+|\\s+$', '', 'g') AS compressed
  FROM parts p LEFT JOIN lines USING (session_id) LEFT JOIN extracts USING (session_id)),
before AS (SELECT session_id, 0 AS turn_id, original AS content FROM sides), {_entity_rows("before", "named_before")}, after AS (SELECT session_id, 0 AS turn_id, compressed AS content FROM sides), {_entity_rows("after", "named_after")},
names_before AS (SELECT session_id, list(DISTINCT name) AS n FROM named_before GROUP BY session_id), names_after AS (SELECT session_id, list(DISTINCT name) AS n FROM named_after GROUP BY session_id),
apart AS (SELECT s.session_id, {_word_sets("original", "compressed")}, CASE WHEN len(b.n) > 0 THEN len(list_intersect(b.n, coalesce(a.n, []))) / len(b.n) ELSE 1.0 END AS recall FROM sides s LEFT JOIN names_before b USING (session_id) LEFT JOIN names_after a USING (session_id)),
worst AS (SELECT session_id, recall, greatest(CASE WHEN len(wa) + len(wb) > 0 THEN 1 - len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) ELSE 0.0 END, 1 - recall) AS w FROM apart),
verdict AS (SELECT session_id, round(w, 4) AS drift_score, w <= 0.15 AS passed, true AS fallback_used, CASE WHEN w <= 0.15 THEN 'proceed' WHEN w <= 0.3 THEN 'use_lossless' ELSE 'abort_compression' END AS recommendation, round(recall, 4) AS entity_recall, round(1 - recall, 4) AS entity_loss FROM worst)"""


@query("WITH RECURSIVE " + _GATED + " SELECT * FROM verdict")
def quality_gate(spark, sf_dir):
    every = turns(spark, sf_dir)
    return quality.gated(savings.contexts(every, reuse.once(savings.annotated(every, savings.Settings()))), "original", "compressed").drop("original", "compressed")


@query("WITH RECURSIVE " + _GATED + " SELECT session_id, drift_score, 0.15::DOUBLE AS threshold, passed, fallback_used, recommendation, 'lossy' AS mode_before, 'lossless' AS mode_after FROM verdict WHERE NOT passed")
def gate_log(spark, sf_dir):
    return telemetry.gate_log(quality_gate(spark, sf_dir), quality.THRESHOLD)


def _mode_sums(stage: str, held: str, mode: str) -> str:
    gone = ", ".join(f"coalesce(sum(tokens) FILTER ({stage} = '{s}'), 0) AS {s}" for s in savings.STAGES)
    return f"""{mode} AS (SELECT session_id, count(*) AS turns, count(*) FILTER ({stage} IS NULL) AS turns_kept, sum(raw_tokens) AS raw, sum(tokens) AS clean, {gone}, coalesce(min(similarity) FILTER ({stage} = 'deduplication'), 1.0) AS c1,
  coalesce(1 - max(score) FILTER ({stage} = 'relevance'), 1.0) AS c2, max({held}) > 4000 AS summarized FROM staged GROUP BY session_id)"""


@query(f"""WITH RECURSIVE {_GATED}, {_mode_sums("stage", "held", "lossy")}, {_mode_sums("stage_safe", "held_safe", "safe")},
chosen AS (SELECT p.session_id, p.system, p.query, v.drift_score, v.passed, v.recommendation AS gate, CASE WHEN v.passed THEN l ELSE s END AS x FROM parts p JOIN verdict v USING (session_id) LEFT JOIN lossy l ON l.session_id = p.session_id LEFT JOIN safe s ON s.session_id = p.session_id),
sums AS (SELECT *, coalesce(x.raw, 0) AS raw, coalesce(x.clean, 0) AS clean, coalesce(x.deduplication, 0) AS d, coalesce(x.relevance, 0) AS r, coalesce(x.summarization, 0) AS s, {_TOK.format("system")} AS ts, {_TOK.format(_CLEAN_SYSTEM)} AS tc, {_TOK.format("query")} + 3 AS f FROM chosen),
figures AS (SELECT *, ts + raw + f AS raw_tokens, tc + clean - d - r - s + f AS post_tokens, greatest(ts - tc + raw - clean, 0) AS structural FROM sums),
totals AS (SELECT *, greatest(raw_tokens - post_tokens, 0) AS total, greatest(raw_tokens - post_tokens, 0) - structural - d - r - s AS adjusted FROM figures)
SELECT session_id, coalesce(x.turns, 0) AS turns, coalesce(x.turns_kept, 0) AS turns_kept, CAST(raw_tokens AS BIGINT) AS raw_tokens, CAST(post_tokens AS BIGINT) AS post_tokens, CAST(structural AS BIGINT) AS structural, CAST(d AS BIGINT) AS deduplication, CAST(r AS BIGINT) AS relevance, CAST(s AS BIGINT) AS summarization,
round(least(coalesce(x.c1, 1.0), coalesce(x.c2, 1.0), CASE WHEN x.summarized THEN 0.85 ELSE 1.0 END), 4) AS confidence, coalesce(x.summarized, false) AS summarized, drift_score, passed, gate, CAST(total AS BIGINT) AS token_savings, CAST(adjusted AS BIGINT) AS adjustment,
round(100 * total / greatest(raw_tokens, 1), 2) AS pct_saved, CASE WHEN passed AND greatest(d, r, s, adjusted) > 0 THEN 'lossy' ELSE 'lossless' END AS mode FROM totals""")
def pipeline_savings(spark, sf_dir):
    return savings.gated(turns(spark, sf_dir))


#: Settings under which the test conversations meet every stage.
_BRISK = savings.Settings(dedup_threshold=0.3, max_history_tokens=150, keep_recent=2, with_entities=False)
_PLAN = f"""{_TURNS}, {_SPLIT}, rows_in AS (SELECT session_id, turn_id, role, content AS raw, {_CLEAN} AS content, query FROM history), {_VECTORS}, {_GREEDY.format(0.3)},
sized AS (SELECT r.*, k.kept AS kept_dedup, 4 + {_TOK.format("role")} + {_TOK.format("raw")} AS raw_tokens, 4 + {_TOK.format("role")} + {_TOK.format("content")} AS tokens, {_word_sets("content", "query")} FROM rows_in r JOIN kept k ON k.block = r.session_id AND k.row = r.turn_id),
judged AS (SELECT *, round({_OCHIAI.format("wa", "wb")}, 4) AS score FROM sized),
placed AS (SELECT *, kept_dedup AND (@KEEP@) AS stays, sum(CASE WHEN kept_dedup AND (@KEEP@) THEN tokens ELSE 0 END) OVER (PARTITION BY session_id) + 3 AS held,
  count(*) FILTER (kept_dedup AND (@KEEP@)) OVER (PARTITION BY session_id ORDER BY turn_id DESC) AS after FROM judged),
staged AS (SELECT *, CASE WHEN NOT kept_dedup THEN 'deduplication' WHEN NOT stays THEN 'relevance' WHEN held > 150 AND after > 2 THEN 'summarization' END AS stage FROM placed),
per AS (SELECT session_id, count(*) AS turns, count(*) FILTER (stage IS NULL) AS turns_kept, sum(raw_tokens) AS raw, sum(tokens) AS clean, coalesce(sum(tokens) FILTER (stage = 'deduplication'), 0) AS d, coalesce(sum(tokens) FILTER (stage = 'relevance'), 0) AS r, coalesce(sum(tokens) FILTER (stage = 'summarization'), 0) AS s FROM staged GROUP BY ALL)
SELECT p.session_id, coalesce(turns, 0) AS turns, coalesce(turns_kept, 0) AS turns_kept, CAST(coalesce(raw, 0) + 3 + {_TOK.format("p.system")} + {_TOK.format("p.query")} AS BIGINT) AS raw_tokens,
CAST(coalesce(clean - d - r - s, 0) + 3 + {_TOK.format(_WS.format(_PUNCT.format("p.system")))} + {_TOK.format("p.query")} AS BIGINT) AS post_tokens,
CAST(coalesce(d, 0) AS BIGINT) AS deduplication, CAST(coalesce(r, 0) AS BIGINT) AS relevance, CAST(coalesce(s, 0) AS BIGINT) AS summarization FROM parts p LEFT JOIN per USING (session_id)"""
_MEASURES = ("session_id", "turns", "turns_kept", "raw_tokens", "post_tokens", "deduplication", "relevance", "summarization")


_COSINE = "CASE WHEN list_dot_product({0}, {0}) * list_dot_product({1}, {1}) > 0 THEN list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))) ELSE 0.0 END"
_DENSE = f"""vecs AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
rows_in AS (SELECT h.session_id, h.turn_id, h.role, h.content AS raw, {_CLEAN.replace('content', 'h.content')} AS content, h.query, v.e, q.e AS qe FROM history h JOIN parts p ON p.session_id = h.session_id
  JOIN vecs v ON v.vec_id = (h.session_id * 31 + h.turn_id) % 500 LEFT JOIN vecs q ON q.vec_id = (p.session_id * 31 + p.query_turn) % 500),
pairs AS (SELECT x.session_id AS block, x.turn_id AS a, y.turn_id AS b, {_COSINE.format('x.e', 'y.e')} AS similarity FROM rows_in x JOIN rows_in y ON x.session_id = y.session_id AND x.turn_id < y.turn_id)"""


def _measured(spark, sf_dir, settings: savings.Settings) -> DataFrame:
    every = turns(spark, sf_dir)
    return savings.measured(every, savings.annotated(every, settings), settings).select(*_MEASURES)


@query("WITH RECURSIVE " + _PLAN.replace("@KEEP@", "score >= 0.15").replace(f"rows_in AS (SELECT session_id, turn_id, role, content AS raw, {_CLEAN} AS content, query FROM history), {_VECTORS}", _DENSE).replace(f"round({_OCHIAI.format('wa', 'wb')}, 4) AS score", f"round(coalesce({_COSINE.format('e', 'qe')}, 0.0), 4) AS score"))
def pipeline_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    every = turns(spark, sf_dir)
    with_vectors = every.withColumn("_v", (F.col("session_id") * 31 + F.col("turn_id")) % 500).join(vectors, "_v", "left").drop("_v")
    settings = dataclasses.replace(_BRISK, vector="vector")
    return savings.measured(every, savings.annotated(with_vectors, settings), settings).select(*_MEASURES)


@query("WITH RECURSIVE " + _PLAN.replace("@KEEP@", "score >= 0.15"))
def pipeline_lossy(spark, sf_dir):
    return _measured(spark, sf_dir, _BRISK)


@query("WITH RECURSIVE " + _PLAN.replace("@KEEP@", "true"))
def pipeline_lossless(spark, sf_dir):
    from dataclasses import replace

    return _measured(spark, sf_dir, replace(_BRISK, mode="lossless"))


# --- telemetry -------------------------------------------------------------------------------


@query(f"WITH {_FACTS} SELECT request_id, endpoint, model, raw_tokens, post_tokens, token_savings, pct_saved, cost_usd_saved, confidence_score, overhead_ms FROM facts")
def telemetry_events(spark, sf_dir):
    return facts(spark, sf_dir).select("request_id", "endpoint", "model", "raw_tokens", "post_tokens", "token_savings", "pct_saved", "cost_usd_saved", "confidence_score", "overhead_ms")


@query(f"""WITH {_FACTS} SELECT count(*) AS total_requests, CAST(sum(token_savings) AS BIGINT) AS total_token_savings, round(sum(cost_usd_saved), 4) AS total_cost_saved_usd, round(100 * sum(token_savings) / sum(raw_tokens), 2) AS avg_pct_saved,
round(avg(overhead_ms), 2) AS avg_overhead_ms, round(avg(llm_latency_ms) FILTER (llm_latency_ms <> 0), 2) AS avg_llm_latency_ms, round(avg(confidence_score), 4) AS avg_confidence, min(confidence_score) AS min_confidence FROM facts""")
def aggregate_stats(spark, sf_dir):
    return telemetry.totals(facts(spark, sf_dir))


@query(f"WITH {_FACTS} SELECT endpoint, count(*) AS requests, CAST(sum(token_savings) AS BIGINT) AS token_savings, round(sum(cost_usd_saved), 6) AS cost_usd_saved FROM facts GROUP BY endpoint")
def by_endpoint(spark, sf_dir):
    return telemetry.by(facts(spark, sf_dir), "endpoint")


@query(f"WITH {_FACTS} SELECT 'structural' AS stage, CAST(sum(s_structural) AS BIGINT) AS tokens_saved FROM facts UNION ALL SELECT 'deduplication', CAST(sum(s_dedup) AS BIGINT) FROM facts")
def stage_totals(spark, sf_dir):
    return telemetry.stage_totals(facts(spark, sf_dir))


@query(f"WITH {_FACTS} SELECT request_id, session_id, model, compression_mode, confidence_score, 'deduplication,structural' AS stages_applied FROM facts WHERE compression_mode = 'lossy' OR confidence_score < 1")
def confidence_log(spark, sf_dir):
    return telemetry.confidence_log(facts(spark, sf_dir)).select("request_id", "session_id", "model", "compression_mode", "confidence_score", F.array_join("stages_applied", ",").alias("stages_applied"))


@query(f"WITH {_FACTS} SELECT request_id, endpoint, model, session_id, raw_tokens, post_tokens, token_savings, pct_saved, cost_usd_saved FROM facts ORDER BY ts DESC, request_id DESC LIMIT 500")
def attribution_last_n(spark, sf_dir):
    return telemetry.last(telemetry.attribution(facts(spark, sf_dir)), 500).drop("ts", "savings_by_stage")


@query(f"WITH {_FACTS} SELECT CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(token_savings) AS BIGINT) AS token_savings FROM facts WHERE ts >= TIMESTAMP '2024-01-15'")
def session_totals(spark, sf_dir):
    return telemetry.since(facts(spark, sf_dir), F.lit("2024-01-15").cast("timestamp_ntz"))


@query(f"""WITH {_FACTS} SELECT endpoint, count(*) AS n, min(overhead_ms) AS min_ms, round(avg(overhead_ms), 6) AS mean_ms, median(overhead_ms) AS median_ms, max(overhead_ms) AS max_ms, round(coalesce(stddev_samp(overhead_ms), 0), 6) AS stdev_ms,
list_sort(list(overhead_ms))[greatest(1, CAST(floor(count(*) * 0.95) AS BIGINT))] AS p95_ms FROM facts GROUP BY endpoint""")
def latency_stats(spark, sf_dir):
    return telemetry.latency(facts(spark, sf_dir), "endpoint", "overhead_ms")


@query(f"WITH {_FACTS}, d AS (SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, cost_usd_saved FROM facts) SELECT month, day, count(*) AS requests, round(sum(cost_usd_saved), 6) AS cost_usd_saved FROM d GROUP BY ROLLUP (month, day)")
def cost_rollup(spark, sf_dir):
    return telemetry.cost_rollup(facts(spark, sf_dir))


@query(f"WITH {_FACTS}, m AS (SELECT avg(raw_tokens) AS raw, avg(post_tokens) AS post FROM facts) SELECT CAST(v AS INTEGER) AS requests_per_day, round(v * 30 * raw / 1e6 * 5.0, 2) AS baseline_usd, round(v * 30 * post / 1e6 * 5.0, 2) AS compressed_usd FROM m, (SELECT unnest([1000, 10000, 100000]) AS v)")
def monthly_cost(spark, sf_dir):
    return telemetry.monthly_cost(facts(spark, sf_dir))


@query(f"WITH {_FACTS} SELECT request_id, 'deduplication' AS stage, confidence_score AS confidence FROM facts WHERE s_dedup > 0")
def removed_details(spark, sf_dir):
    detail = F.struct(F.lit("deduplication").alias("stage"), F.lit(None).cast("double").alias("confidence"), F.when(F.col("savings_by_stage")["deduplication"] > 0, F.array(F.col("endpoint"))).otherwise(F.array().cast("array<string>")).alias("removed_texts"))
    return telemetry.removed_details(facts(spark, sf_dir).withColumn("compression_details", F.array(detail))).select("request_id", "stage", "confidence")


@query(f"""WITH {_FACTS}, s AS (SELECT request_id, session_id, ts FROM facts WHERE endpoint = '/chat'), c AS (SELECT request_id, session_id, ts FROM facts WHERE compression_mode = 'lossy')
SELECT s.request_id, any_value(s.session_id) AS session_id, arg_max(c.request_id, (c.ts, c.request_id)) AS last_request_id FROM s LEFT JOIN c ON c.session_id = s.session_id AND c.ts < s.ts GROUP BY s.request_id""")
def context_loss_asof(spark, sf_dir):
    f = facts(spark, sf_dir)
    signals = f.where("endpoint = '/chat'").select("request_id", "session_id", "ts")
    latest = f.where("compression_mode = 'lossy'").groupBy("session_id", "ts").agg(F.max("request_id").alias("request_id"))
    return telemetry.as_of(signals, latest, "session_id", "ts", ("request_id",)).select("request_id", "session_id", "last_request_id")


@query(f"""WITH {_FACTS}, s AS (SELECT request_id, session_id, ts FROM facts WHERE endpoint = '/chat'), c AS (SELECT request_id, session_id, ts FROM facts WHERE compression_mode = 'lossy'),
a AS (SELECT s.request_id, any_value(s.session_id) AS session_id, arg_max(c.request_id, (c.ts, c.request_id)) AS last_request_id FROM s LEFT JOIN c ON c.session_id = s.session_id AND c.ts < s.ts GROUP BY s.request_id),
d AS (SELECT request_id, 'structural' AS stage, s_structural AS removed_index, endpoint AS entity FROM facts WHERE s_structural > 0 UNION ALL SELECT request_id, 'deduplication', s_dedup, model FROM facts WHERE s_dedup > 0),
h AS (SELECT request_id, array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages, array_to_string(list_sort(list(DISTINCT removed_index)), ',') AS removed_indices, array_to_string(list_sort(list(DISTINCT entity)), ',') AS entities FROM d GROUP BY request_id)
SELECT a.request_id, session_id, last_request_id, stages, removed_indices, entities FROM a LEFT JOIN h ON h.request_id = a.last_request_id""")
def context_loss_log(spark, sf_dir):
    f = facts(spark, sf_dir)
    each = f.select("request_id", F.explode(F.array(*[F.struct(F.lit(stage).alias("stage"), F.col("savings_by_stage")[stage].alias("removed_index"), F.col(entity).alias("entity")) for stage, entity in (("structural", "endpoint"), ("deduplication", "model"))])).alias("d"))
    log = telemetry.loss_log(context_loss_asof(spark, sf_dir), each.select("request_id", "d.*").where("removed_index > 0"))
    joined = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("stages", "removed_indices", "entities")}
    return log.withColumns(joined).select("request_id", "session_id", "last_request_id", *joined)


@query(f"WITH {_FACTS} SELECT session_id, arg_max(request_id, (ts, request_id)) AS request_id, arg_max(confidence_score, (ts, request_id)) AS confidence_score FROM facts WHERE compression_mode = 'lossy' GROUP BY session_id")
def last_compression(spark, sf_dir):
    latest = facts(spark, sf_dir).where("compression_mode = 'lossy'").select("session_id", "ts", "request_id", "confidence_score")
    return telemetry.last_compression(latest).select("session_id", "request_id", "confidence_score")


@query(f"WITH {_FACTS} SELECT session_id, count(*) AS turns, max(ts) + INTERVAL 86400 SECOND >= TIMESTAMP '2024-01-30' AS live FROM facts GROUP BY session_id")
def session_registry(spark, sf_dir):
    return graph.registry(facts(spark, sf_dir), F.lit("2024-01-30").cast("timestamp")).select("session_id", "turns", "live")


@query(f"WITH {_FACTS} SELECT compression_mode AS mode, count(*) AS requests, round(avg(pct_saved), 1) AS mean_pct, min(pct_saved) AS min_pct, max(pct_saved) AS max_pct, round(avg(confidence_score), 4) AS mean_confidence FROM facts GROUP BY compression_mode")
def savings_summary(spark, sf_dir):
    return telemetry.savings_summary(facts(spark, sf_dir))


@query(f"WITH {_FACTS} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, round(sum(cost_usd_saved), 4) AS cost_usd_saved FROM facts GROUP BY day")
def cost_high_water(spark, sf_dir):
    f, mark = facts(spark, sf_dir), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    earlier = telemetry.rolled_up_since(f.where(F.col("ts") <= mark))
    # all events come again: those up to each day's mark were counted
    return telemetry.rolled_up_since(f, earlier).select("day", "requests", F.round("cost_usd_saved", 4).alias("cost_usd_saved"))


_LOOKUPS = f"""{_FACTS}, log AS (SELECT session_id AS key, request_id, epoch(ts) AS t, row_number() OVER (PARTITION BY session_id ORDER BY ts, request_id) AS i FROM facts),
walk AS (SELECT key, request_id, i, false AS hit, t + 3600 AS until FROM log WHERE i = 1
  UNION ALL SELECT l.key, l.request_id, l.i, l.t <= w.until, CASE WHEN l.t <= w.until THEN w.until ELSE l.t + 3600 END FROM walk w JOIN log l ON l.key = w.key AND l.i = w.i + 1)"""


def _looked_up(spark, sf_dir) -> DataFrame:
    log = facts(spark, sf_dir).select(F.col("session_id").alias("key"), "request_id", "ts")
    return cache.lookups(log, "key", "ts", cache.TTL_SECONDS["prefix"], "request_id")


@query(f"WITH RECURSIVE {_LOOKUPS} SELECT key, request_id, hit FROM walk")
def cache_hits(spark, sf_dir):
    return _looked_up(spark, sf_dir).select("key", "request_id", "hit")


@query(f"WITH RECURSIVE {_LOOKUPS} SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(DISTINCT key) FILTER (NOT hit) AS size FROM walk")
def cache_stats(spark, sf_dir):
    return cache.stats(_looked_up(spark, sf_dir))


def _entries(spark, sf_dir) -> DataFrame:
    f = facts(spark, sf_dir)
    return f.select(F.concat_ws(":", F.lit("entity_graph"), "endpoint", "session_id").alias("key"), F.col("request_id").alias("value"), (F.col("ts").cast("timestamp") + F.make_interval(secs=F.lit(86_400))).alias("expires_at"))


@query(f"WITH {_FACTS} SELECT 'entity_graph:' || endpoint || ':' || session_id AS key, request_id AS value FROM facts WHERE ts + INTERVAL 86400 SECOND >= TIMESTAMP '2024-01-20'")
def cache_sweep(spark, sf_dir):
    return cache.swept(_entries(spark, sf_dir), F.lit("2024-01-20").cast("timestamp")).select("key", "value")


@query(f"""WITH {_FACTS}, e AS (SELECT 'entity_graph:' || endpoint || ':' || session_id AS key, max(request_id) AS value, max(ts) + INTERVAL 86400 SECOND AS expires_at FROM facts GROUP BY 1),
fresh AS (SELECT key, -value AS value, TIMESTAMP '2024-01-20' + INTERVAL 3600 SECOND AS expires_at FROM e WHERE value % 10 = 0),
held AS (SELECT * FROM e WHERE value % 10 <> 0 UNION ALL SELECT * FROM fresh)
SELECT e.key, h.value, h.key IS NOT NULL AS hit FROM e LEFT JOIN held h ON h.key = e.key AND h.expires_at >= TIMESTAMP '2024-01-20'""")
def cache_get_put(spark, sf_dir):
    entries = _entries(spark, sf_dir).groupBy("key").agg(F.max("value").alias("value"), F.max("expires_at").alias("expires_at"))
    now = F.lit("2024-01-20").cast("timestamp")
    held = cache.put(entries, entries.where("value % 10 = 0").select("key", (-F.col("value")).alias("value")), now, 3600)
    return cache.get(held, entries.select("key"), now).select("key", "value", "hit")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT x.vec_id, round(1 - greatest(-1.0, least(1.0, list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))))), 6) AS distance FROM v x JOIN v y ON y.vec_id = x.vec_id + 1""")
def embedding_drift(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    both = v.select("vec_id", F.col("embedding").alias("e")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after")), "vec_id")
    return both.select("vec_id", F.round(similarity.cosine_distance(F.col("e"), F.col("after")), 6).alias("distance"))


@query(f"WITH {_FACTS} SELECT 'entity_graph:' || endpoint || ':' || session_id AS key, request_id AS value FROM facts WHERE CAST(session_id AS BIGINT) % 10 <> 0")
def session_invalidate(spark, sf_dir):
    gone = facts(spark, sf_dir).where(F.col("session_id").cast("long") % 10 == 0).select("session_id").distinct()
    return cache.invalidated(_entries(spark, sf_dir), gone).select("key", "value")


@query(f"WITH {_FACTS}, n AS (SELECT request_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY request_id) AS request_no FROM facts) SELECT request_id, CAST(request_no AS INTEGER) AS request_no FROM n WHERE request_no % 20 = 0")
def sweep_points(spark, sf_dir):
    return cache.sweep_points(facts(spark, sf_dir), "request_id", 20, "session_id").select("request_id", "request_no")


# --- windows over event time -----------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def telemetry_window(spark, sf_dir):
    out = windows.tumbling(table(spark, sf_dir, "events"), "1 day", "event_type", "value")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""SELECT time_bucket(INTERVAL 12 HOUR, ts) - h * INTERVAL 12 HOUR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1]) AS h) GROUP BY ALL""")
def sliding_telemetry(spark, sf_dir):
    out = windows.tumbling(table(spark, sf_dir, "events"), "1 day", "event_type", "value", slide="12 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark, sf_dir):
    out = windows.sessions(table(spark, sf_dir, "events"), "30 minutes", "user_id")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
