"""Caches as tables: what an ordered log of lookups would have hit, and upkeep of entries.

Times are timestamps; nothing reads a clock, `now` is a parameter.
"""

from __future__ import annotations

import bisect
import collections
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField

from . import ordered

TTL_SECONDS = {"turn": 300, "prefix": 3600, "compose": 180, "chat": 120, "default": 120, "graph": 86_400}
SWEEP_EVERY = 200


class Expiry:
    """Until when a key's entry is valid: a lookup after that is a miss and writes it anew."""

    takes = ("_t",)
    gives = [StructField("hit", BooleanType())]  # noqa: RUF012

    def __init__(self, ttl_seconds: float):
        self.ttl = ttl_seconds

    def begin(self) -> float:
        return -math.inf

    def move(self, until: float, t: float | None) -> tuple[float, tuple]:
        if t is not None and t <= until:
            return until, (True,)
        return (-math.inf if t is None else t + self.ttl), (False,)

    def transition(self) -> ExpiryTransition:
        return ExpiryTransition(self.ttl)


class ExpiryTransition:
    """What every end of an entry written before these lookups comes to.

    Ends that lie before a lookup begin anew at it and go on as one, so they are grouped by what they have come to.  An
    entry from before ends within a time to live of the first lookup, so there are no more groups than lookups in that time.
    """

    def __init__(self, ttl: float):
        self.ttl, self.first, self.reset = ttl, None, False
        self.below: list[float] = []  # the k-th interval of ends lies below below[k], and not below the one before
        self.groups: collections.deque[tuple[float, list[int]]] = collections.deque()  # (valid until, intervals), the first to end first

    def add(self, t: float | None) -> None:
        if t is None:  # nulls come first, and nothing is valid after them
            self.reset = True
            return
        self.first = t if self.first is None else self.first
        anew: list[int] = []
        while self.groups and self.groups[0][0] < t:
            one = self.groups.popleft()[1]
            anew, one = (one, anew) if len(one) > len(anew) else (anew, one)
            anew.extend(one)
        if not self.below or self.below[-1] < t and self.below[-1] <= self.first + self.ttl:
            self.below.append(t)
            anew.append(len(self.below) - 1)
        if anew:
            self.groups.append((t + self.ttl, anew))

    def of(self, until: float) -> float:
        k = bisect.bisect_right(self.below, -math.inf if self.reset else until)
        if k == len(self.below):
            return -math.inf if self.reset else until
        return next(end for end, intervals in self.groups if k in intervals)


def lookups(log: DataFrame, key: str, ts: str, ttl_seconds: int, tie: str | None = None) -> DataFrame:
    """log and hit: whether the key's entry was still valid.  A miss writes the entry anew; a hit doesn't prolong it.

    Entries begin at misses, so a key's lookups form runs: each run is a miss and the lookups within its time to live.
    A key's log may hold any part of all rows: it is folded in ranges of its order.
    """
    if tie is None:
        raise ValueError(f"{[ts]}: lookups at one time need a column that orders them")
    timed = log.withColumn("_t", F.col(ts).cast("timestamp").cast("double"))
    return ordered.folded(timed, key, [F.asc("_t"), F.asc(tie)], Expiry(ttl_seconds)).drop("_t")


def stats(looked_up: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """hits, misses and size (of entries, or of the distinct keys written)."""
    counts = looked_up.agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))
    size = entries.agg(F.count("*").alias("size")) if entries is not None else looked_up.where(~F.col("hit")).agg(F.countDistinct("key").alias("size"))
    return counts.crossJoin(size)  # one row each


def swept(entries: DataFrame, now: Column) -> DataFrame:
    """Entries that haven't expired."""
    return entries.where(F.col("expires_at") >= now)


def get(entries: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """keys and value, expires_at, hit of their valid entries."""
    valid = entries.where(F.col("expires_at") >= now)
    return keys.join(valid, "key", "left").withColumn("hit", F.col("expires_at").isNotNull())


def put(entries: DataFrame, new: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Entries with new ones (key, value) in place of those of equal key."""
    fresh = new.select("key", "value", (now + F.make_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))
    return entries.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def invalidated(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Entries whose key doesn't end with one of the sessions' ids (keys of sessions are kind:user:session)."""
    own = entries.withColumn("_s", F.element_at(F.split("key", ":"), -1))
    return own.join(sessions.select(F.col("session_id").cast("string").alias("_s")), "_s", "left_anti").drop("_s")


def sweep_points(requests: DataFrame, order: str, every: int = SWEEP_EVERY, by: str | None = None) -> DataFrame:
    """Requests at which a sweep is due: each `every`-th, within a worker if `by` names one."""
    window = Window.partitionBy(by).orderBy(order) if by else Window.orderBy(order)
    return requests.withColumn("request_no", F.row_number().over(window)).where(F.col("request_no") % every == 0)
