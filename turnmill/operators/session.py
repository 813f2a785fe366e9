"""Chat sessions: what a prompt holds after each user message, with a summary of what no longer fits.

A session keeps its summary, the recent messages, and of older ones since the last eviction how
often each word that carries a topic occurred and where first, and the begin of their text: what
their summary takes, of a size that doesn't grow with the messages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import normalize_prompt

from .summary import KEY_POINT_STOPS, KEY_POINTS

RECENT, CONTEXT_TOKENS, SUMMARY_CHARS = 4, 800, 600
TURN = "turn_id long, context string, context_tokens long, summary string, recent_message_count long"
_WORD = re.compile(r"\b[a-z]{3,}\b")


class Older:
    """Words of messages out of the window: word to (count, first place), the text's begin and how many messages there are."""

    def __init__(self, words: dict[str, tuple[int, int]] | None = None, begin: str = "", place: int = 0, messages: int = 0):
        self.words, self.begin, self.place, self.messages = words if words is not None else {}, begin, place, messages

    def get(self, word: str) -> tuple[int, int] | None:
        return self.words.get(word)

    def put(self, word: str, value: tuple[int, int]) -> None:
        self.words[word] = value

    def items(self) -> Iterator[tuple[str, tuple[int, int]]]:
        return iter(self.words.items())

    def clear(self) -> None:
        self.words.clear()

    def add(self, content: str) -> None:
        self.messages += 1
        if not content:
            return
        if len(self.begin) < SUMMARY_CHARS:
            self.begin = (self.begin + " " + content if self.begin else content)[:SUMMARY_CHARS]
        for word in _WORD.findall(content.lower()):
            if word not in KEY_POINT_STOPS:
                known = self.get(word)
                self.put(word, (1, self.place) if known is None else (known[0] + 1, known[1]))
                self.place += 1

    def evicted(self) -> str:
        """Their summary; none of them is kept."""
        top = sorted(self.items(), key=lambda w: (-w[1][0], w[1][1]))[:KEY_POINTS]
        out = ("Key points: " + ", ".join(w for w, _ in top) if top else self.begin)[:SUMMARY_CHARS]
        self.clear()
        self.begin, self.place, self.messages = "", 0, 0
        return out


class Session:
    """One session's state; `add` takes a user message and gives the columns of TURN without the turn's id."""

    def __init__(self, recent: int = RECENT, most: int = CONTEXT_TOKENS, summary: str = "", messages: list[str] | None = None, older: Older | None = None):
        self.recent, self.most, self.summary, self.messages, self.older = recent, most, summary, messages or [], older or Older()

    def _context(self, n: int) -> tuple[str, int]:
        last = self.messages[-n:] if n > 0 else []
        lines = ([f"Summary: {self.summary}"] if self.summary else []) + (["Recent:", *(f"User: {m}" for m in last)] if last else [])
        text = "\n".join(lines)
        return text, len(text.split())

    def add(self, content: str) -> tuple[str, int, str, int]:
        context, tokens = self._context(self.recent)
        if tokens > self.most:
            told = self.older.evicted()
            self.summary = f"{self.summary} {told}".strip() if self.summary else told
            context, tokens = self._context(self.recent)
        n = self.recent - 1
        while n > 0 and tokens > self.most:
            context, tokens = self._context(n)
            n -= 1
        self.messages.append(content)
        held = self.older.messages + len(self.messages)
        while len(self.messages) > self.recent:
            self.older.add(self.messages.pop(0))
        return context, tokens, self.summary, held


def user_messages(turns: DataFrame) -> DataFrame:
    """session_id, turn_id and the cleaned content of user turns."""
    return turns.where("role = 'user'").select("session_id", F.col("turn_id").cast("long").alias("turn_id"), normalize_prompt(F.col("content")).alias("content"))


def chat_turns(turns: DataFrame, recent: int = RECENT, most: int = CONTEXT_TOKENS) -> DataFrame:
    """session_id and the columns of TURN for every user turn; a session's turns are folded in order, one at a time."""
    messages = user_messages(turns)
    key = messages.schema["session_id"].dataType.simpleString()
    names = [c.split(" ")[0] for c in TURN.split(", ")]

    def fold(batches):
        last, session = object(), None
        for batch in batches:
            rows = []
            for s, turn, content in zip(*(batch.column(c).to_pylist() for c in ("session_id", "turn_id", "content")), strict=True):
                if s != last:
                    last, session = s, Session(recent, most)
                rows.append((turn, *session.add(content)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_pydict({"session_id": batch.column("session_id")} | {c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(names, kinds, strict=True))})

    return messages.repartition("session_id").sortWithinPartitions("session_id", "turn_id").mapInArrow(fold, f"session_id {key}, {TURN}")
