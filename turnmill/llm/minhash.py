"""Near-duplicate documents by bottom-k sketches from one hash function.

Every document keeps the k least of its shingles' hashes.  Documents with equal sets are one
class from the start.  Inverted lists of retained values give the pairs of classes that may
overlap; an estimate from the sketch of the union drops most others; the exact Jaccard
similarity of the full sets decides.

Which values are listed.  Two sets with similarity s or more have at least `least_shared`
common values in their sketches (all of ceil(s * n) where the set is no larger than k; beyond,
with a binomial tail below 1e-9).  So under one global order both lists' first
m - least_shared + 1 values share one.  The order is by how many classes hold a value, rare
ones first: values that many documents share are listed only for documents with little else.

Long lists.  Classes with values that more than `long_list` classes hold among those listed
are listed again by their full sets, where only the rarest fraction is needed.  What still is in
long lists is a group of near copies: each is compared with the list's hub, and the rest by
what they differ in from the hub (`_around_hubs`), so no link between components is lost and the
work stays in proportion to the group's size.

Nulls and ties: a null text is empty; a document without words is linked with nothing.  A
null doc_id is in no link, has component null and stays.  Classes are named by their sets, so
rows of one doc_id with different texts keep all their links; in `near_duplicates` such rows
share a component, as they share the id, in `one_of_each` each text is in its own group.  Of rows
equal in doc_id and text `one_of_each` keeps one, of those that differ in other columns the one
of least hash.  Other columns of the input are carried along unseen.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_of, saved, text_of
from .components import components
from .shingles import shingle_sets

_MISS = 1e-9


def least_shared(k: int, percent: int) -> int:
    """The greatest t for which two sketches of k values have fewer than t in common with a chance below _MISS."""
    p, tail, t = percent / 100, 0.0, 0
    while True:
        tail += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if tail > _MISS:
            return max(1, t)
        t += 1


def _digest(hashes: np.ndarray) -> str:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()


def _signed(hashes: list[np.ndarray]) -> pa.Array:
    """Lists of 64-bit hashes as arrays of longs."""
    ends = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, width: int, k: int, rows_at_once: int = 2000) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, digest (of the whole set) and sketch (the k least hashes)."""

    def make(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                rows = batch.slice(at, rows_at_once)
                sets = shingle_sets(rows.column("text"), width)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "mark": rows.column("mark"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "digest": [_digest(s) for s in sets], "sketch": _signed([s[:k] for s in sets])})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), text_of(docs).alias("text"))
    return source.mapInArrow(make, "doc_id long, mark long, n_shingles long, digest string, sketch array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """digest and full set of the documents whose ids stand for the wanted classes (column doc_id)."""

    def make(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                sets = shingle_sets(batch.slice(at, 2000).column("text"), width)
                yield pa.RecordBatch.from_pydict({"digest": [_digest(s) for s in sets], "hashes": _signed(sets)})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).join(wanted, "doc_id", "left_semi")
    return source.select("text").mapInArrow(make, "digest string, hashes array<long>")


class _Links:
    """Compares pairs of classes (columns a < b, na, nb)."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, k: int, percent: int):
        self.docs, self.classes, self.width, self.k, self.percent = docs, classes, width, k, percent
        self.least = least_shared(k, percent)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """node, hashes of the wanted classes (column node), from documents that hold their sets."""
        own = self.classes.select("node", "digest", "doc_id").join(wanted, "node", "left_semi")
        # a doc_id may have texts of other sets too, and rows may repeat: the digest tells, and one row a class is kept
        return saved(_sets(self.docs, own.select("doc_id"), self.width).join(own.select("node", "digest"), "digest").dropDuplicates(["node"]).select("node", "hashes"), "sets")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """a, b, whole of the pairs whose union's sketch allows a link; `whole`: both sets are in their sketches and the link is sure."""
        k, percent = self.k, self.percent
        side = lambda c: self.classes.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"))
        held = pairs.join(side("a"), "a").join(side("b"), "b")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        common = F.size(F.array_intersect(F.array_intersect(union, "sa"), F.col("sb")))
        whole = F.greatest("na", "nb") <= k
        likely = F.when(whole, 100 * F.size(F.array_intersect("sa", "sb")) >= percent * F.size(F.array_union("sa", "sb"))).otherwise(common >= F.least(F.lit(self.least), F.size(union)))
        return saved(held.where(likely).select("a", "b", whole.alias("whole")), "hopeful")

    def exact(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b of the pairs that the full sets link."""
        one = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}"))
        both = pairs.join(one("a"), "a").join(one("b"), "b").withColumn("i", F.size(F.array_intersect("ha", "hb")))
        return both.where(100 * F.col("i") >= self.percent * (F.size("ha") + F.size("hb") - F.col("i"))).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        hopeful = self.estimated(pairs)
        open_ = hopeful.where("not whole").select("a", "b")
        sets = self.sets(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        return saved(hopeful.where("whole").select("a", "b").union(self.exact(open_, sets)), "links")


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that stand in one list (v, node, n), each pair once, with sizes that allow a link."""
    x, y = lists.alias("x"), lists.alias("y")
    fits = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    both = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.node") < F.col("y.node"))).where(fits)
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()


def _prefixed(values: DataFrame, room: Column, long_list: int) -> DataFrame:
    """v, node, n, wide, long: each class's rarest values (values: node, n, v), as many as `room` lists of size m leave.

    Values that no other class holds stand first and are not listed; wide is how many of a class's values are in long lists.
    """
    held_by = values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    shared = values.join(held_by, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("held"), F.count(F.when(F.col("c") > long_list, 1)).alias("wide"))
    listed = F.greatest(room + F.size("held"), F.lit(0)).cast("int")
    return shared.select("node", "n", "wide", F.explode(F.slice("held", 1, listed)).alias("x")).select("node", "n", "wide", F.col("x.v").alias("v"), (F.col("x.c") > long_list).alias("long"))


def _around_hubs(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join the components of long lists (v, node, n, wide), without comparing all pairs.

    A list's hub is its class of most widely held values.  D is the difference of a class's set
    from its hub's; two classes differ in |D1| + |D2| - 2 |D1 & D2| values, and are linked if
    that is at most (na + nb) (100 - p) / (100 + p).  Classes linked with their hub are
    joined by it.  A class f that isn't has |D| beyond that bound, so any B it is linked with
    shares more than half of B's own D with it: one of them is among the rarest half of B's D.
    """
    # floats would round: all bounds are kept times (100 + p)
    up, gap = 100 + percent, 100 - percent
    hubs = lists.groupBy("v").agg(F.max_by(F.struct("node", "n"), F.struct("wide", "node")).alias("h")).select("v", F.col("h.node").alias("hub"), F.col("h.n").alias("nh"))
    near = lists.join(hubs, "v").where("node != hub").select("hub", "nh", "node", "n").distinct()
    mine, theirs = sets.select("node", F.col("hashes").alias("x")), sets.select(F.col("node").alias("hub"), F.col("hashes").alias("h"))
    both = near.join(mine, "node").join(theirs, "hub")
    d = F.concat(F.array_except("x", "h"), F.array_except("h", "x"))
    around = both.withColumn("d", d).select("hub", "nh", "node", "n", "d", F.size("d").cast("long").alias("dn"))
    around = saved(around.withColumn("linked", up * F.col("dn") <= gap * (F.col("n") + F.col("nh"))), "around")
    spokes = around.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    free = around.where("not linked").select("hub").distinct()  # hubs that have nothing else to join are done
    entries = around.join(free, "hub", "left_semi").select("hub", "nh", "node", "n", "dn", "linked", F.explode("d").alias("v"))
    often = entries.groupBy("hub", "v").agg(F.count("*").alias("c")).where("c > 1")
    held = entries.join(often, ["hub", "v"])
    probe = held.where("not linked").select("hub", "v", F.col("node").alias("f"))
    # 2 * shared * up > up * |D| - gap * (n - nh)
    shared = F.floor((up * F.col("dn") - gap * (F.col("n") - F.col("nh"))) / (2 * up)) + 1
    ranked = held.groupBy("hub", "nh", "node", "n", "dn").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("held"))
    listed = F.greatest((F.col("dn") - shared + 1) - (F.col("dn") - F.size("held")), F.lit(0)).cast("int")
    index = ranked.select("hub", "node", F.explode(F.slice("held", 1, listed)).alias("x")).select("hub", "node", F.col("x.v").alias("v"))
    pairs = probe.join(index, ["hub", "v"]).where("f != node").select("hub", F.least("f", "node").alias("a"), F.greatest("f", "node").alias("b")).distinct()
    side = lambda c: around.select("hub", F.col("node").alias(c), F.col("d").alias(f"d{c}"), F.col("n").alias(f"n{c}"))
    compared = pairs.join(side("a"), ["hub", "a"]).join(side("b"), ["hub", "b"])
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    others = compared.where(up * apart <= gap * (F.col("na") + F.col("nb"))).select("a", "b")
    return saved(spokes.union(others), "spokes")


def _grouped(docs: DataFrame, width: int, percent: int, k: int, long_list: int) -> tuple[DataFrame, DataFrame]:
    """The sketches without their values, and digest, root for every class; classes of one root can be reached from one another."""
    found = saved(sketches(docs, width, k), "sketches")
    counted = found.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"))
    classes = saved(counted.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so a node keeps its number
    links = _Links(docs, classes, width, k, percent)
    needed = F.ceil(F.col("n") * percent / 100).cast("long")
    # of m retained values, all but least_shared - 1 are listed, less those that no other class holds
    room = 1 - F.least(needed, F.lit(links.least))
    index = saved(_prefixed(classes.select("node", "n", F.explode("sketch").alias("v")), room, long_list), "index")
    known = links.confirmed(_pairs(index.where("not long"), percent))
    wide = index.where("long").select("node").distinct()
    if wide.limit(1).count():
        # the classes in long lists again, by their full sets: their lists are those of the rarest values among themselves
        sets = links.sets(wide)
        full = sets.select("node", F.size("hashes").cast("long").alias("n"), F.explode("hashes").alias("v"))
        lists = saved(_prefixed(full, 1 - needed, long_list), "lists")
        short = links.exact(_pairs(lists.where("not long"), percent), sets)
        known = saved(known.union(short).union(_around_hubs(lists.where("long"), sets, percent)), "known")
    by_class = classes.select("digest", "node").join(components(known), "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return found.drop("sketch"), by_class


def by_document(found: DataFrame, by_class: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of found (doc_id, n_shingles, digest), from the root of every class (digest, root)."""
    ids = found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "digest").agg(F.lit(1).alias("_one")).join(by_class, "digest").select("doc_id", "root")
    least = ids.groupBy("root").agg(F.min("doc_id").alias("least"))
    per_id = saved(ids.join(least, "root").groupBy("doc_id").agg(F.min("least").alias("least"), F.max("least").alias("other")), "ids")
    several = per_id.where("least <> other").select(F.col("least").alias("a"), F.col("other").alias("b"))
    if several.limit(1).count():  # ids with texts in several components join these
        every = ids.join(least, "root").select("doc_id", F.col("least").alias("b")).join(per_id.where("least <> other").select("doc_id", F.col("least").alias("a")), "doc_id")
        moved = components(every.select("a", "b")).select(F.col("node").alias("least"), "root")
        per_id = per_id.join(moved, "least", "left").select("doc_id", F.coalesce("root", "least").alias("least"))
    return found.join(per_id.select("doc_id", "least"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 64, long_list: int = 24) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that can be reached) and kept, for every row of docs."""
    found, by_class = _grouped(docs, width, percent, k, long_list)
    out = by_document(found, by_class)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 64, long_list: int = 24) -> DataFrame:
    """docs without near copies: of each group of linked texts the row of least doc_id, of equal ids that of least text hash."""
    found, by_class = _grouped(docs, width, percent, k, long_list)
    linked = found.where("n_shingles > 0 and doc_id is not null")
    by_digest = linked.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    firsts = by_digest.join(by_class, "digest").groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    times = saved(linked.groupBy("doc_id", "mark").count(), "times")
    gone = saved(times.select("doc_id", "mark").join(firsts, ["doc_id", "mark"], "left_anti"), "gone")
    rows = docs.select(row_of(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"))
    once = rows.join(gone, ["doc_id", "mark"], "left_anti")
    repeated = times.where("count > 1").select("doc_id", "mark").join(gone, ["doc_id", "mark"], "left_anti")
    if repeated.limit(1).count():
        single = once.join(repeated, ["doc_id", "mark"], "left_semi").groupBy("doc_id", "mark").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        once = once.join(repeated, ["doc_id", "mark"], "left_anti").select("row").union(single.select("row"))
    return once.select("row.*")
