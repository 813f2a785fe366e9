"""Streaming state: chat sessions, the entity graph, the rolling summary and the last compression of sessions, and cache entries.

`transformWithStateInPandas` keeps, for each session, the graph's nodes and turns seen, and the
summary, all with a time to live; a turn that comes twice is taken once.
The batch plan (`operators.graph.resolved`) folds the same way, so both agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnmill.operators import session
from turnmill.operators.graph import Graph, named_turns

TTL_MS = 86_400_000
#: Entries of one chunk of a list in state.
CHUNK = 128
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NODES = "session_id string, turn_id long, entities long, mentions long, latest string"
_STATE = "etype string, name string, first_seen_turn long, last_seen_turn long, mention_count long, aliases array<string>"


class _StoredTables:
    """A graph's tables in map state: a turn reads and writes the entries that it meets."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.nodes = handle.getMapState("nodes", "etype string, name string", f"{_STATE}, parts array<string>, place long", TTL_MS)
        # a list is kept in chunks, of which a new entry rewrites the last
        self.lengths = handle.getMapState("lengths", "part string, size int", "entries long, chunks long", TTL_MS)
        self.postings = handle.getMapState("postings", "part string, size int, chunk long", "etypes array<string>, names array<string>", TTL_MS)
        self.types = handle.getMapState("types", "name string", "etype string", TTL_MS)
        self.newest = handle.getMapState("newest", "etype string", "turn long, place long, etype string, name string", TTL_MS)

    _FIELDS = (*(c.split(" ")[0] for c in _STATE.split(", ")), "parts", "order")

    def _as_node(self, row) -> dict:
        node = dict(zip(self._FIELDS, row, strict=True))
        return node | {"aliases": list(node["aliases"]), "parts": list(node["parts"])}

    def node(self, key):
        return self._as_node(self.nodes.getValue(key)) if self.nodes.containsKey(key) else None

    def put_node(self, key, node):
        self.nodes.updateValue(key, tuple(node[f] for f in self._FIELDS))

    def _ends(self, part, size) -> tuple[int, int]:
        return tuple(self.lengths.getValue((part, size))) if self.lengths.containsKey((part, size)) else (0, 0)

    def _chunk(self, part, size, chunk) -> list[tuple[str, str]]:
        return list(zip(*self.postings.getValue((part, size, chunk)), strict=True))

    def _put_chunk(self, part, size, chunk, keys) -> None:
        self.postings.updateValue((part, size, chunk), ([t for t, _ in keys], [n for _, n in keys]))

    def length(self, part, size):
        return self._ends(part, size)[0]

    def posting(self, part, size):
        return (key for chunk in range(self._ends(part, size)[1]) for key in self._chunk(part, size, chunk))

    def enlist(self, part, size, key):
        n, chunks = self._ends(part, size)
        last = self._chunk(part, size, chunks - 1) if chunks else []
        if not chunks or len(last) >= CHUNK:
            last, chunks = [], chunks + 1
        self._put_chunk(part, size, chunks - 1, [*last, key])
        self.lengths.updateValue((part, size), (n + 1, chunks))

    def strike(self, part, size, key):
        n, chunks = self._ends(part, size)
        for chunk in range(chunks):
            keys = self._chunk(part, size, chunk)
            if key in keys:
                self._put_chunk(part, size, chunk, [k for k in keys if k != key])
                self.lengths.updateValue((part, size), (n - 1, chunks))
                return

    def type_of(self, name):
        return self.types.getValue((name,))[0] if self.types.containsKey((name,)) else None

    def put_type(self, name, etype):
        self.types.updateValue((name,), (etype,))

    def latest(self, etype):
        found = self.newest.getValue((etype or "",)) if self.newest.containsKey((etype or "",)) else None
        return (found[0], found[1], (found[2], found[3])) if found else None

    def put_latest(self, etype, value):
        self.newest.updateValue((etype or "",), (value[0], value[1], *value[2]))

    def items(self):
        return ((tuple(k), self._as_node(v)) for k, v in self.nodes.iterator())


class GraphProcessor(StatefulProcessor):
    """Emits the size of a session's graph after each batch of its turns."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tables = _StoredTables(handle)
        self.totals = handle.getValueState("totals", "entities long, mentions long", TTL_MS)
        self.seen = handle.getMapState("turns", "turn_id long", "added boolean", TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        graph = Graph((), self.tables, *(self.totals.get() if self.totals.exists() else (0, 0)))
        turn_id = -1
        for turn in pd.concat(list(rows)).sort_values("turn_id").itertuples():
            turn_id = int(turn.turn_id)
            if not self.seen.containsKey((turn_id,)):
                self.seen.updateValue((turn_id,), (True,))
                graph.add(turn_id, turn.content, [(e["etype"], e["name"]) for e in turn.named])
        self.totals.update((graph.entities, graph.mentions))
        latest = graph.latest(None)
        yield pd.DataFrame({"session_id": [str(key[0])], "turn_id": [turn_id], "entities": [graph.entities], "mentions": [graph.mentions], "latest": [latest[1] if latest else None]})

    def close(self) -> None:
        pass


def graph_stream(turns: DataFrame) -> DataFrame:
    """A stream of turns as a stream of graph sizes (columns of NODES); needs the RocksDB state store."""
    keyed = named_turns(turns).withColumn("session_id", F.col("session_id").cast("string"))
    return keyed.groupBy("session_id").transformWithStateInPandas(GraphProcessor(), NODES, "update", "processingTime")


class _StoredWords(session.Older):
    """The words of older messages in map state: a message touches its own words alone."""

    def __init__(self, words, begin: str, place: int, messages: int):
        super().__init__({}, begin, place, messages)
        self.stored = words

    def get(self, word: str) -> tuple[int, int] | None:
        return tuple(self.stored.getValue((word,))) if self.stored.containsKey((word,)) else None

    def put(self, word: str, value: tuple[int, int]) -> None:
        self.stored.updateValue((word,), value)

    def items(self) -> Iterator[tuple[str, tuple[int, int]]]:
        return ((k[0], tuple(v)) for k, v in self.stored.iterator())

    def clear(self) -> None:
        self.stored.clear()


class ChatProcessor(StatefulProcessor):
    """What a session's prompt holds after each user message; all state of a session that is idle for the time to live is dropped."""

    def __init__(self, recent: int, most: int):
        self.recent, self.most = recent, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "summary string, begin string, place long, messages long, last_turn long")
        self.messages = handle.getListState("recent", "content string")
        self.words = handle.getMapState("words", "word string", "n long, place long")

    def _expire_later(self, timerValues) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        summary, begin, place, messages, last = self.head.get() if self.head.exists() else ("", "", 0, 0, None)
        held = [m[0] for m in self.messages.get()] if self.messages.exists() else []
        now = session.Session(self.recent, self.most, summary, held, _StoredWords(self.words, begin, place, messages))
        out = []
        for row in pd.concat(list(rows)).sort_values("turn_id").itertuples():
            if last is None or row.turn_id > last:  # a turn that comes again is taken once
                last = int(row.turn_id)
                out.append((str(key[0]), last, *now.add(row.content)))
        self.head.update((now.summary, now.older.begin, now.older.place, now.older.messages, last))
        if now.messages:
            self.messages.put([(m,) for m in now.messages])
        self._expire_later(timerValues)
        yield pd.DataFrame(out, columns=["session_id", *(c.split(" ")[0] for c in session.TURN.split(", "))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.head.clear()
        self.messages.clear()
        self.words.clear()
        yield pd.DataFrame(columns=["session_id", *(c.split(" ")[0] for c in session.TURN.split(", "))])

    def close(self) -> None:
        pass


def chat_stream(turns: DataFrame, recent: int = session.RECENT, most: int = session.CONTEXT_TOKENS) -> DataFrame:
    """A stream of turns as a stream of what prompts hold (session_id and the columns of `session.TURN`), as `session.chat_turns` gives of a table."""
    keyed = session.user_messages(turns).withColumn("session_id", F.col("session_id").cast("string"))
    return keyed.groupBy("session_id").transformWithStateInPandas(ChatProcessor(recent, most), f"session_id string, {session.TURN}", "update", "processingTime")


class SummaryProcessor(StatefulProcessor):
    """Keeps a session's summary: each compressed text is joined to what there was and cut from the front's end at `chars`."""

    def __init__(self, chars: int = 800):
        self.chars = chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.summary = handle.getValueState("summary", "text string", TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.summary.get()[0] if self.summary.exists() else ""
        for row in pd.concat(list(rows)).sort_values("turn_id").itertuples():
            now = " | ".join(p for p in (now, row.extract) if p)[: self.chars]
        self.summary.update((now,))
        yield pd.DataFrame({"session_id": [str(key[0])], "summary": [now]})

    def close(self) -> None:
        pass


def summary_stream(extracts: DataFrame, chars: int = 800) -> DataFrame:
    """A stream of extracts (session_id, turn_id, extract) as a stream of rolling summaries."""
    keyed = extracts.withColumn("session_id", F.col("session_id").cast("string"))
    return keyed.groupBy("session_id").transformWithStateInPandas(SummaryProcessor(chars), "session_id string, summary string", "update", "processingTime")


class LastCompressionProcessor(StatefulProcessor):
    """Keeps a session's latest compression and gives it to the signals that come after it.

    Rows hold details (a compression) or null (a signal); in the order of t and id each signal gets the details before it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "id long, details string", TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values(["t", "id"]).itertuples():
            if row.details is not None:
                last = (int(row.id), row.details)
            else:
                out.append((str(key[0]), int(row.id), *(last or (None, None))))
        if last:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["session_id", "id", "last_id", "details"]).astype({"last_id": "Int64"})

    def close(self) -> None:
        pass


def last_compression_stream(rows: DataFrame) -> DataFrame:
    """A stream of compressions and signals (session_id, id, t, details) as a stream of signals: session_id, id, last_id, details."""
    keyed = rows.select(F.col("session_id").cast("string").alias("session_id"), F.col("id").cast("long").alias("id"), F.col("t").cast("double").alias("t"), F.col("details").cast("string").alias("details"))
    return keyed.groupBy("session_id").transformWithStateInPandas(LastCompressionProcessor(), "session_id string, id long, last_id long, details string", "update", "processingTime")


class CacheProcessor(StatefulProcessor):
    """hit for each lookup of a key: whether its entry, written at the last miss, was still valid at the lookup's own time."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "t double", TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else float("-inf")
        data = pd.concat(list(rows)).sort_values(["t", "id"])
        hits = []
        for t in data["t"]:
            hits.append(t <= until)
            until = until if hits[-1] else t + self.ttl
        self.until.update((float(until),))
        yield pd.DataFrame({"key": str(key[0]), "id": data["id"].to_numpy(), "hit": hits})

    def close(self) -> None:
        pass


def cache_stream(log: DataFrame, ttl_seconds: int) -> DataFrame:
    """A stream of lookups (key, id, t in seconds) as a stream of key, id, hit."""
    keyed = log.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("t").cast("double").alias("t"))
    return keyed.groupBy("key").transformWithStateInPandas(CacheProcessor(ttl_seconds), "key string, id long, hit boolean", "update", "processingTime")
