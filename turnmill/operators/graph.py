"""Entities of sessions: edges from turns to entities, the index by exact name, and the graph with resolution and references.

Resolution depends on the order of turns and on aliases that grow, so it is a fold over one
session (`resolved`): sessions are the unit of distribution, and a fold's state is one session's
entities.  Everything else is joins and aggregates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from turnmill.functions import entities

OVERLAP = 0.7
#: What refers to the latest entity of a type, or of any type (None), in order.  Fixed values.
REFERENCES = (
    ("function", r"\b(that|this)\s+function\b"), ("file", r"\b(the\s+file\s+I\s+mentioned|that\s+file|this\s+file)\b"), ("module", r"\b(that|this)\s+module\b"), ("class", r"\b(that|this)\s+class\b"),
    ("task", r"\b(that|this)\s+(task|ticket|issue|bug|pr|story)\b"), ("variable", r"\b(that|this)\s+variable\b"), ("url", r"\b(that|this)\s+url\b"), (None, r"\b(it|this)\b"),
)
_REFERENCES = [(t, re.compile(p, re.I)) for t, p in REFERENCES]
NODE = "session_id {key}, etype string, name string, first_seen_turn long, last_seen_turn long, mention_count long, aliases array<string>"


def edges(turns: DataFrame) -> DataFrame:
    """session_id, turn_id, etype, ord, pos, name of every entity of every turn."""
    return turns.select("session_id", "turn_id", F.explode(entities.listed(F.col("content"))).alias("e")).select("session_id", "turn_id", "e.etype", "e.ord", "e.pos", "e.name")


def index(edge: DataFrame) -> DataFrame:
    """One row for each session, type and name: first and last turn, and in how many turns it is named."""
    return edge.groupBy("session_id", "etype", "name").agg(F.min("turn_id").alias("first_seen_turn"), F.max("turn_id").alias("last_seen_turn"), F.countDistinct("turn_id").alias("mention_count"))


def snapshot(edge: DataFrame) -> DataFrame:
    """session_id, entities: type to names in the order they came."""
    first = edge.groupBy("session_id", "etype", "name").agg(F.min(F.struct("turn_id", "ord", "pos")).alias("at"))
    types = first.groupBy("session_id", "etype").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
    return types.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("etype", "names")))).alias("entities"))


def removed_names(texts: DataFrame, key: str, content: str) -> DataFrame:
    """key, entities: the sorted distinct names of a group's removed texts."""
    each = texts.select(key, F.explode(entities.all_names(F.col(content))).alias("n"))
    return each.groupBy(key).agg(F.array_sort(F.collect_set("n")).alias("entities"))


_SAVED = "array<struct<name:string,etype:string,first_seen_turn:bigint,last_seen_turn:bigint,mention_count:bigint,aliases:array<string>>>"


def serialised(nodes: DataFrame) -> DataFrame:
    """session_id, graph: a session's nodes (columns of NODE) as JSON, in the order of type and name."""
    each = F.struct("name", "etype", "first_seen_turn", "last_seen_turn", "mention_count", "aliases")
    held = nodes.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("etype", "name", each.alias("n")))).alias("l"))
    return held.select("session_id", F.to_json(F.struct(F.transform("l", lambda x: x["n"]).alias("entities"))).alias("graph"))


def reloaded(saved: DataFrame) -> DataFrame:
    """The nodes of serialised graphs; fields that are missing have what a new node has."""
    each = saved.select("session_id", F.explode(F.from_json("graph", f"struct<entities:{_SAVED}>")["entities"]).alias("n"))
    or_ = lambda c, v: F.coalesce(F.col(f"n.{c}"), v).alias(c)
    zero = F.lit(0).cast("long")
    return each.select("session_id", or_("etype", F.lit("")), or_("name", F.lit("")), or_("first_seen_turn", zero), or_("last_seen_turn", zero), or_("mention_count", F.lit(1).cast("long")), or_("aliases", F.array().cast("array<string>")))


def registry(activity: DataFrame, now: Column, ttl_seconds: int = 86_400) -> DataFrame:
    """session_id, turns, first_ts, last_ts and live (within the time to live of its last turn) of every session (activity: session_id, ts)."""
    seen = activity.groupBy("session_id").agg(F.count("*").alias("turns"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return seen.withColumn("live", F.col("last_ts").cast("timestamp") + F.make_interval(secs=F.lit(ttl_seconds)) >= now)


class Memory:
    """A graph's tables in dictionaries."""

    def __init__(self):
        self.nodes: dict[tuple[str, str], dict] = {}
        self.postings: dict[tuple[str, int], dict[tuple[str, str], None]] = {}
        self.types: dict[str, str] = {}  # of a name's first node
        self.newest: dict[str | None, tuple[int, int, tuple[str, str]]] = {}  # (last turn, -order, key) by type, None for any

    def node(self, key: tuple[str, str]) -> dict | None:
        return self.nodes.get(key)

    def put_node(self, key: tuple[str, str], node: dict) -> None:
        self.nodes[key] = node

    def length(self, part: str, size: int) -> int:
        return len(self.postings.get((part, size), ()))

    def posting(self, part: str, size: int) -> Iterable[tuple[str, str]]:
        return self.postings.get((part, size), ())

    def enlist(self, part: str, size: int, key: tuple[str, str]) -> None:
        self.postings.setdefault((part, size), {})[key] = None

    def strike(self, part: str, size: int, key: tuple[str, str]) -> None:
        del self.postings[part, size][key]

    def type_of(self, name: str) -> str | None:
        return self.types.get(name)

    def put_type(self, name: str, etype: str) -> None:
        self.types[name] = etype

    def latest(self, etype: str | None) -> tuple[int, int, tuple[str, str]] | None:
        return self.newest.get(etype)

    def put_latest(self, etype: str | None, value: tuple[int, int, tuple[str, str]]) -> None:
        self.newest[etype] = value

    def items(self) -> Iterable[tuple[tuple[str, str], dict]]:
        return self.nodes.items()


class Graph:
    """One session's entities as turns come.

    Nodes are found through an inverted index from a name's part and the node's number of parts: names that overlap by 0.7 are of
    similar sizes and share all but few parts, so only the shortest lists of the right sizes are read, and a turn touches
    the nodes that it meets.
    """

    def __init__(self, nodes: Iterable[dict] = (), tables: Memory | None = None, entities_: int = 0, mentions: int = 0):
        self.tables, self.entities, self.mentions = tables or Memory(), entities_, mentions
        for n in nodes:
            self._insert((n["etype"], n["name"]), dict(n, aliases=list(n["aliases"])), set().union(*(name_parts(x) for x in (n["name"], *n["aliases"]))))

    @property
    def nodes(self) -> dict[tuple[str, str], dict]:
        """All nodes in the order they came."""
        kept = [c.split(" ")[0] for c in NODE.split(", ")][1:]
        return {k: {c: n[c] for c in kept} for k, n in sorted(self.tables.items(), key=lambda x: x[1]["order"])}

    def _list(self, key: tuple[str, str], parts: set[str], old: set[str] = frozenset()) -> None:
        """Moves a node's entries to where its parts, and their number, now belong."""
        if parts != old:
            for part in old:
                self.tables.strike(part, len(old), key)
            for part in parts:
                self.tables.enlist(part, len(parts), key)

    def _insert(self, key: tuple[str, str], node: dict, parts: set[str]) -> None:
        self.tables.put_node(key, node | {"parts": sorted(parts), "order": self.entities})
        self._list(key, parts)
        if self.tables.type_of(key[1]) is None:
            self.tables.put_type(key[1], key[0])
        self.entities, self.mentions = self.entities + 1, self.mentions + node["mention_count"]
        self._seen(key, node["last_seen_turn"], self.entities - 1)

    def _seen(self, key: tuple[str, str], turn_id: int, order: int) -> None:
        for etype in (key[0], None):
            now, mine = self.tables.latest(etype), (turn_id, -order, key)
            if now is not None and now[2] == key and mine < now:  # a turn that comes late: another node may be the latest now
                mine = max((n["last_seen_turn"], -n["order"], k) for k, n in self.tables.items() if etype in (None, k[0]))
                self.tables.put_latest(etype, mine)
            elif now is None or mine > now:
                self.tables.put_latest(etype, mine)

    def resolve(self, name: str) -> str:
        """The name of the earliest entity that shares most parts (0.7 or more of either), else the name."""
        own = set(name_parts(name))
        least = math.ceil(OVERLAP * len(own) - 1e-9)
        best = (OVERLAP, 1, name)
        for size in range(max(1, least), math.floor(len(own) / OVERLAP + 1e-9) + 1):
            # of the parts, all but `least - 1` are looked up: one of these is shared
            short = sorted(own, key=lambda part: self.tables.length(part, size))[: len(own) - max(1, least) + 1]
            for key in {k for part in short for k in self.tables.posting(part, size)}:
                node = self.tables.node(key)
                share = len(own.intersection(node["parts"])) / max(len(own), size)
                if share >= OVERLAP:
                    best = max(best, (share, -node["order"], key[1]), key=lambda x: x[:2] if x[1] != 1 else (OVERLAP, -math.inf))
        return best[2]

    def latest(self, etype: str | None) -> tuple[str, str] | None:
        """The entity (of a type) seen last; the earliest of equals."""
        found = self.tables.latest(etype)
        return found[2] if found else None

    def add(self, turn_id: int, content: str, named: list[tuple[str, str]]) -> None:
        """A turn's entities (type, name), and what its words refer to."""
        mentioned = dict.fromkeys(named)
        for etype, pattern in _REFERENCES:
            if (target := self.latest(etype)) is not None and pattern.search(content):
                mentioned.setdefault((etype or self.tables.type_of(target[1]), target[1]))
        # types in the order in which the turn first names them, as its entities are indexed type by type
        order = {t: k for k, t in reversed(list(enumerate(dict.fromkeys(t for t, _ in mentioned))))}
        for etype, name in sorted(mentioned, key=lambda m: order[m[0]]):
            key = (etype, self.resolve(name))
            node = self.tables.node(key)
            if node is None:
                new = {"etype": etype, "name": key[1], "first_seen_turn": turn_id, "last_seen_turn": turn_id, "mention_count": 1, "aliases": [name] if name != key[1] else []}
                self._insert(key, new, set(name_parts(key[1])) | set(name_parts(name)))
            else:
                node = dict(node, last_seen_turn=turn_id, mention_count=node["mention_count"] + 1)
                if name != key[1] and name not in node["aliases"]:
                    old = set(node["parts"])
                    parts = old | set(name_parts(name))
                    node |= {"aliases": [*node["aliases"], name], "parts": sorted(parts)}
                    self._list(key, parts, old)
                self.tables.put_node(key, node)
                self.mentions += 1
                self._seen(key, turn_id, node["order"])


_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def name_parts(name: str) -> list[str]:
    """As functions.entities.name_parts, for one name."""
    found = (p.lower() for run in re.findall("[A-Za-z0-9]+", name) for p in _PART.findall(run))
    stems = (p[: entities.STEM] if len(p) >= entities.STEM_FROM else p for p in found if p not in entities.GENERIC and p not in entities.EXTENSIONS)
    return [p for p in stems if len(p) >= entities.SHORTEST]


def named_turns(turns: DataFrame) -> DataFrame:
    """session_id, turn_id, content and named, an array of (etype, name), found by columns."""
    return turns.select("session_id", "turn_id", F.coalesce("content", F.lit("")).alias("content"), F.transform(entities.listed(F.col("content")), lambda e: F.struct(e["etype"], e["name"])).alias("named"))


def resolved(turns: DataFrame) -> DataFrame:
    """Entity nodes of every session, with resolution and references (columns of NODE)."""
    key = turns.schema["session_id"].dataType.simpleString()

    kept = [c.split(" ")[0] for c in NODE.split(", ")]
    arrow = to_arrow_schema(StructType.fromDDL(NODE.format(key=key)))

    def fold(rows: pa.Table) -> pa.Table:
        graph, of = Graph(), rows.column("session_id")[0].as_py()
        for turn in sorted(rows.select(["turn_id", "content", "named"]).to_pylist(), key=lambda t: t["turn_id"]):
            graph.add(turn["turn_id"], turn["content"], [(e["etype"], e["name"]) for e in turn["named"]])
        nodes = list(graph.nodes.values())
        return pa.Table.from_pydict({c: [of] * len(nodes) if c == kept[0] else [n[c] for n in nodes] for c in kept}, schema=arrow)

    return named_turns(turns).groupBy("session_id").applyInArrow(fold, NODE.format(key=key))
