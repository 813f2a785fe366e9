"""Similarity join of documents' shingle sets by parity sketches.

A sketch is a row of parts of BITS bits.  Every shingle of a set flips the one bit that its hash
names, so two sketches differ in no more bits than the sets differ in shingles: the Hamming
distance is a lower bound of the symmetric difference.  Two sets of na and nb shingles with
similarity p or more differ in D = (na + nb) (100 - p) / (100 + p) at most.

Size bands.  A band's sizes lie within a factor of 1 / p^2, so linked documents are of one band or of two
neighbouring ones.  A band's sketches have parts for its largest D; a document is sketched for its
own band, and for the next one up where its partners may reach that.

Pigeonhole.  Linked sketches have all but D parts in common.  A part's value is a key, and of a
document's keys the first D + 1 are listed, in the order of how many documents hold a key (those
no other holds come first and aren't listed): two such lists share one.  So the parts that few
shingles fell into, and many documents share, are left out, and lists stay short as the corpus
grows.  Pairs in one list are compared by size and by their sketches' Hamming distance, and the
rest by the full sets.

Long lists.  A list of more than `long_list` documents is a group of near copies, or documents that
share a passage.  Each is compared with the list's hub, the document that is in most long lists; where
few are not linked with it, these are compared with those of the list whose Hamming distance from the hub is
near their own (two sketches differ in no fewer bits than their distances from a third do).  Where many aren't, the list's documents are
sketched again, in twice as many parts, of which only the rarer half is listed, so documents that merely
share a passage leave such lists; what stays long and unlinked even then is compared by what its documents
differ in from the hub (`minhash._around_hubs`).  Pairs of short lists that links join already are not
compared again.  So no two documents that links connect come apart, and the work keeps to a group's size.

Documents with equal sets are one class from the start.  A null text is empty; a document
without words is linked with nothing.  A null doc_id is in no link and has component null.
Rows of one doc_id with different texts are classes of their own that share a component.
Other columns of the input don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of
from .components import components
from .minhash import _around_hubs, _digest, _Links, _signed, by_document
from .shingles import bounded, shingle_sets

#: Bits of one part, two 64-bit words.
BITS, WORDS = 128, 2
#: Parts that need not agree and aren't listed: one for so many of those that must, at first and for long lists.
SPARE, SPARE_AGAIN = 8, 1


def apart(both: int, percent: int) -> int:
    """The most shingles in which sets with so many together may differ."""
    return both * (100 - percent) // (100 + percent)


def bands(largest: int, percent: int, spare: int = SPARE) -> list[tuple[int, int]]:
    """(greatest size, parts of a sketch) of every band up to a size."""
    out, low = [], 1
    while low <= largest:
        high = max(low, low * 10_000 // percent**2)
        most = apart(2 * high, percent)
        out.append((high, most + 1 + (most + 4) // spare))
        low = high + 1
    return out


def sketch(shingles: np.ndarray, parts: int) -> np.ndarray:
    """The parity of the shingles at each bit, as 64-bit words."""
    # the upper half of the hash picks the bit, so parts are equally likely
    bit = (shingles >> np.uint64(32)) * np.uint64(parts * BITS) >> np.uint64(32)
    out = np.zeros(parts * WORDS, np.uint64)
    np.bitwise_xor.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def drawn(sets: list[np.ndarray], percent: int, spare: int) -> dict[str, pa.Array]:
    """Columns band, own and up of sets of hashes: the sketches for a set's band and, where its partners reach it, the next."""
    sizes = np.array([len(s) for s in sets], np.int64)
    known = bands(int(sizes.max(initial=1)) * 10_000 // percent**2 + 1, percent, spare)  # the largest set's band and the next
    of = np.searchsorted([high for high, _ in known], sizes)
    none = np.empty(0, np.uint64)
    own = [sketch(s, known[b][1]) if len(s) else none for s, b in zip(sets, of, strict=True)]
    up = [sketch(s, known[b + 1][1]) if len(s) * 100 // percent > known[b][0] else none for s, b in zip(sets, of, strict=True)]
    return {"band": pa.array(of.astype(np.int32)), "own": _signed(own), "up": _signed(up)}


def sketches(docs: DataFrame, width: int, percent: int, rows_at_once: int = 1000) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set), band, own, up of every row."""

    def make(batches):
        for batch in batches:
            for rows in bounded(batch, "text", rows_at_once):
                sets = shingle_sets(rows.column("text"), width)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "digest": [_digest(s) for s in sets]} | drawn(sets, percent, SPARE))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return source.mapInArrow(make, "doc_id long, n_shingles long, digest string, band int, own array<long>, up array<long>")


def sketched_again(sets: DataFrame, percent: int, rows_at_once: int = 1000) -> DataFrame:
    """node, n, band, own, up of sets (node, hashes), in more parts."""

    def make(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                rows = batch.slice(at, rows_at_once)
                held = [s.values.to_numpy().view(np.uint64) for s in rows.column("hashes")]
                yield pa.RecordBatch.from_pydict({"node": rows.column("node"), "n": pa.array([len(s) for s in held], pa.int64())} | drawn(held, percent, SPARE_AGAIN))

    return sets.select("node", "hashes").mapInArrow(make, "node long, n long, band int, own array<long>, up array<long>")


def _most_apart(both: Column, percent: int) -> Column:
    return F.floor(both * (100 - percent) / (100 + percent)).cast("int")


def keys(classes: DataFrame, percent: int) -> DataFrame:
    """v (a hash of band, part and the part's bits) and side (2 * node, and 1 more in its own band) of all parts of all sketches."""

    def of(column: str, band: Column, own: int) -> Column:
        part = lambda k: F.xxhash64(band, k, F.element_at(column, WORDS * k + 1), F.element_at(column, WORDS * k + 2))
        made = F.transform(F.sequence(F.lit(0), (F.size(column) / WORDS).cast("int") - 1), part)
        side = (2 * F.col("node") + own).alias("side")
        return F.when(F.size(column) > 0, F.transform(made, lambda v: F.struct(v.alias("v"), side))).otherwise(F.array().cast("array<struct<v:bigint,side:bigint>>"))

    # sets that nothing but an equal one can be linked with need no keys
    alone = _most_apart(F.col("n") + F.floor(F.col("n") * 100 / percent), percent) == 0
    both = F.concat(of("own", F.col("band"), 1), of("up", F.col("band") + 1, 0))
    return classes.where(~alone).select(F.explode(both).alias("k")).select("k.v", "k.side")


def listed(classes: DataFrame, percent: int, long_list: int) -> DataFrame:
    """v, node, n, own, wide, long: each sketch's keys that other classes hold too, the rarest first, as many as linked sketches must share one of; wide: how many of them are in long lists."""
    held = keys(classes, percent)
    often = held.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    several = held.join(often, "v").groupBy("side").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("held"))
    shared = several.withColumn("node", F.shiftright("side", 1)).withColumn("is_own", F.col("side").bitwiseAND(1) == 1)
    known = shared.join(classes.select("node", "n", (F.size("own") / WORDS).cast("int").alias("p_own"), (F.size("up") / WORDS).cast("int").alias("p_up")), "node")
    parts = F.when(F.col("is_own"), F.col("p_own")).otherwise(F.col("p_up"))
    most = _most_apart(F.col("n") + F.floor(F.col("n") * 100 / percent), percent)
    room = F.greatest(most + 1 - (parts - F.size("held")), F.lit(0)).cast("int")
    first = known.select("node", "n", "is_own", F.slice("held", 1, room).alias("held"))
    wide = F.size(F.filter("held", lambda x: x["c"] > long_list)).cast("long")
    return first.select("node", "n", F.col("is_own").alias("own"), wide.alias("wide"), F.explode("held").alias("x")).select("x.v", "node", "n", "own", "wide", (F.col("x.c") > long_list).alias("long"))


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb of classes in one list whose sizes allow a link, each pair once; two from the band below meet in their own band."""
    x, y = lists.alias("x"), lists.alias("y")
    fits = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    both = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.node") < F.col("y.node"))).where(fits & (F.col("x.own") | F.col("y.own")))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()


def _hamming(one: Column, other: Column) -> Column:
    """In how many bits two sketches of one kind differ."""
    return F.aggregate(F.zip_with(one, other, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, d: t + d)


def near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs whose sketches differ in no more bits than linked sets may differ in shingles."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("band").alias(f"band_{c}"), F.col("own").alias(f"own_{c}"), F.col("up").alias(f"up_{c}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b")
    # both sketches are those of the higher band
    one = F.when(F.col("band_a") < F.col("band_b"), F.col("up_a")).otherwise(F.col("own_a"))
    other = F.when(F.col("band_b") < F.col("band_a"), F.col("up_b")).otherwise(F.col("own_b"))
    return saved(held.where(_hamming(one, other) <= _most_apart(F.col("na") + F.col("nb"), percent)).select("a", "b"), "near")


def _apart_yet(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs that known links (a, b) don't join already."""
    roots = saved(components(known), "roots")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    met = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return met.where(~F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))).drop("root_a", "root_b")


def _from_hubs(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """v, node, n, own, hub, nh, distance: the Hamming distance of each document of a list from the list's hub, in the list's own kind of sketch."""
    hubs = lists.groupBy("v").agg(F.max_by(F.struct("node", "n", "own"), F.struct("wide", "node")).alias("h")).select("v", F.col("h.node").alias("hub"), F.col("h.n").alias("nh"), F.col("h.own").alias("hub_own"))
    spread = lists.join(hubs, "v").where("node != hub").select("v", "node", "n", "own", "hub", "nh", "hub_own")
    side = lambda c: classes.select(F.col("node").alias(c), F.col("own").alias(f"{c}_a"), F.col("up").alias(f"{c}_b"))
    met = spread.select("node", "own", "hub", "hub_own").distinct().join(side("node"), "node").join(side("hub"), "hub")
    one, other = F.when(F.col("own"), F.col("node_a")).otherwise(F.col("node_b")), F.when(F.col("hub_own"), F.col("hub_a")).otherwise(F.col("hub_b"))
    distances = met.select("node", "own", "hub", "hub_own", _hamming(one, other).alias("distance"))
    return saved(spread.join(distances, ["node", "own", "hub", "hub_own"]).select("v", "node", "n", "own", "hub", "nh", "distance"), "spread")


def _in_list(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (node, own, ...) with `sketch`, in the list's own kind."""
    held = classes.select("node", F.col("own").alias("_own"), F.col("up").alias("_up"))
    return rows.join(held, "node").withColumn("sketch", F.when(F.col("own"), F.col("_own")).otherwise(F.col("_up"))).drop("own", "_own", "_up")


def _with_hubs(lists: DataFrame, classes: DataFrame, sets: DataFrame, links: _Links, percent: int, few: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of long lists: of each list with its hub, and of up to `few` others with the list; and the lists with more others."""
    fits = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    spread = _from_hubs(lists, classes)
    hopeful = spread.where(fits("n", "nh") & (F.col("distance") <= _most_apart(F.col("n") + F.col("nh"), percent)))
    spokes = saved(links.exact(hopeful.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets), "spokes")
    free = saved(spread.join(spokes.select(F.col("a").alias("hub"), F.col("b").alias("node")), ["hub", "node"], "left_anti").select("v", "node", "n", "own", "distance"), "free")
    many = free.groupBy("v").count().where(F.col("count") > few).select("v")
    # a list's unlinked documents, `few` at most, in one row: each document of the list meets them there, and pairs are formed only of those near it
    met = _in_list(free.join(many, "v", "left_anti"), classes).groupBy("v").agg(F.collect_list(F.struct("node", "n", "distance", "sketch")).alias("free"))
    rest = _in_list(spread.select("v", "node", "n", "own", "distance").join(met.select("v"), "v", "left_semi"), classes)

    def close(x: Column) -> Column:
        most = _most_apart(x["n"] + F.col("n"), percent)
        cheap = (x["node"] != F.col("node")) & fits(x["n"], F.col("n")) & (F.abs(x["distance"] - F.col("distance")) <= most)
        return cheap & (_hamming(x["sketch"], F.col("sketch")) <= most)

    near_ = rest.join(met, "v").select("node", F.explode_outer(F.transform(F.filter("free", close), lambda x: x["node"])).alias("f")).where("f is not null")
    pairs = saved(near_.select(F.least("f", "node").alias("a"), F.greatest("f", "node").alias("b")).distinct(), "near")
    others = saved(links.exact(pairs, sets), "others")
    return spokes.union(others), saved(lists.join(many, "v", "left_semi"), "unlinked")


def _long(lists: DataFrame, classes: DataFrame, sets: DataFrame, links: _Links, percent: int, long_list: int, few: int) -> DataFrame:
    """Links (a, b) that join all that links among the classes of long lists do."""
    found, rest = _with_hubs(lists, classes, sets, links, percent, few)
    if not rest.limit(1).count():
        return found
    again = saved(sketched_again(sets.join(rest.select("node").distinct(), "node", "left_semi"), percent), "again")
    finer = saved(listed(again, percent, long_list), "finer")
    short = saved(links.exact(near(_pairs(finer.where("not long"), percent), again, percent), sets), "short")
    deeper, rest = _with_hubs(finer.where("long").select("v", "node", "n", "own", "wide"), again, sets, links, percent, few)
    found = found.union(short).union(deeper)
    return found.union(_around_hubs(rest.select("v", "node", "n", "wide"), sets, percent)) if rest.limit(1).count() else found


def joined(docs: DataFrame, width: int = 5, percent: int = 80, long_list: int = 24, few: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach, its own included) for every row of docs."""
    found = saved(sketches(docs, width, percent), "parity")
    counted = found.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n"), *[F.any_value(c).alias(c) for c in ("band", "own", "up")])
    classes = saved(counted.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so a node keeps its number
    links = _Links(docs, classes, width, 1, percent)
    lists = saved(listed(classes, percent, long_list), "lists")
    hopeful = _pairs(lists.where("not long"), percent)
    wide, known = lists.where("long").select("node").distinct(), None
    if wide.limit(1).count():
        known = saved(_long(lists.where("long").select("v", "node", "n", "own", "wide"), classes, links.sets(wide), links, percent, long_list, few), "known")
        hopeful = _apart_yet(hopeful, known)
    hopeful = near(hopeful, classes, percent)
    linked = links.exact(hopeful, links.sets(hopeful.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    every = linked if known is None else linked.union(known)
    by_class = classes.select("digest", "node").join(components(every), "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return by_document(found.select("doc_id", "n_shingles", "digest"), by_class)
