"""Telemetry of requests: events, logs, totals and rollups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.functions import tokens

from . import reuse

#: Leading bits of a 64-bit key by which ranks are found, 11 bits a round.
SHIFTS = (53, 42, 31, 20, 9, 0)
KEEP = {"telemetry": 1000, "confidence": 1000, "attribution": 500, "gate": 500, "loss": 500}


def recorded(facts: DataFrame) -> DataFrame:
    """facts (raw_tokens, post_tokens, model, confidence_score, overhead_ms, ...) with token_savings, pct_saved and cost_usd_saved."""
    saved = F.greatest(F.col("raw_tokens") - F.col("post_tokens"), F.lit(0))
    return facts.withColumns({
        "token_savings": saved, "pct_saved": tokens.percent(F.col("raw_tokens"), F.col("post_tokens")), "cost_usd_saved": tokens.saved_cost(saved, F.col("model")),
        "confidence_score": F.round("confidence_score", 4), "overhead_ms": F.round("overhead_ms", 3),
    })


def confidence_log(events: DataFrame) -> DataFrame:
    """Lossy events and those of less than full confidence."""
    chosen = events.where((F.col("compression_mode") == "lossy") | (F.col("confidence_score") < 1))
    return chosen.select("request_id", "ts", "session_id", "model", "compression_mode", "confidence_score", F.array_sort(F.map_keys("savings_by_stage")).alias("stages_applied"))


def attribution(events: DataFrame) -> DataFrame:
    return events.select("request_id", "ts", "endpoint", "model", "session_id", "raw_tokens", "post_tokens", "token_savings", "pct_saved", "cost_usd_saved", "savings_by_stage")


def last(events: DataFrame, n: int, order: tuple[str, ...] = ("ts", "request_id")) -> DataFrame:
    """The last n events, oldest first; all for n = 0."""
    if n == 0:
        return events.orderBy(*order)
    return events.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def totals(events: DataFrame) -> DataFrame:
    """One row over all events; zeros, and confidence 1, without any."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return events.agg(
        F.count("*").alias("total_requests"),
        F.coalesce(F.sum("token_savings"), F.lit(0)).alias("total_token_savings"),
        F.round(zero(F.sum("cost_usd_saved")), 4).alias("total_cost_saved_usd"),
        F.round(zero(100 * F.sum("token_savings") / F.sum("raw_tokens")), 2).alias("avg_pct_saved"),
        F.round(zero(F.avg("overhead_ms")), 2).alias("avg_overhead_ms"),
        F.round(zero(F.avg(F.when(F.col("llm_latency_ms") != 0, F.col("llm_latency_ms")))), 2).alias("avg_llm_latency_ms"),
        F.round(F.coalesce(F.avg("confidence_score"), F.lit(1.0)), 4).alias("avg_confidence"),
        F.coalesce(F.min("confidence_score"), F.lit(1.0)).alias("min_confidence"),
    )


def by(events: DataFrame, column: str) -> DataFrame:
    """Requests, tokens and cost saved for each value of a column."""
    return events.groupBy(column).agg(F.count("*").alias("requests"), F.sum("token_savings").alias("token_savings"), F.round(F.sum("cost_usd_saved"), 6).alias("cost_usd_saved"))


def stage_totals(events: DataFrame) -> DataFrame:
    """Tokens saved by each stage."""
    return events.select(F.explode("savings_by_stage").alias("stage", "saved")).groupBy("stage").agg(F.sum("saved").alias("tokens_saved"))


def since(events: DataFrame, start: Column) -> DataFrame:
    """Raw and saved tokens of events from `start` on."""
    return events.where(F.col("ts") >= start).agg(F.coalesce(F.sum("raw_tokens"), F.lit(0)).alias("raw_tokens"), F.coalesce(F.sum("token_savings"), F.lit(0)).alias("token_savings"))


def cost_rollup(events: DataFrame) -> DataFrame:
    """Requests and cost saved by month and day, with subtotals (null day, null month)."""
    dated = events.select(F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "cost_usd_saved")
    return dated.rollup("month", "day").agg(F.count("*").alias("requests"), F.round(F.sum("cost_usd_saved"), 6).alias("cost_usd_saved"))


def removed_details(events: DataFrame) -> DataFrame:
    """One row for each compression detail that removed texts (compression_details: array of stage, confidence, removed_texts)."""
    each = events.select("request_id", "ts", "confidence_score", F.explode("compression_details").alias("d"))
    return each.where(F.size("d.removed_texts") > 0).select("request_id", "ts", "d.stage", F.coalesce("d.confidence", "confidence_score").alias("confidence"), "d.removed_texts")


def _keyed(samples: DataFrame, group: str, value: str) -> DataFrame:
    """g, v and k of values that aren't null: k is a long in the order of the values (NaN last)."""
    kind = samples.schema[value].dataType.simpleString()
    given = samples.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return given.withColumn("k", F.col("v").cast("long"))
    if kind not in ("float", "double"):
        raise TypeError(f"{value} is a {kind}")

    def make(batches):
        for batch in batches:
            x = batch.column("v").to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
            key = bits ^ (bits >> 63 & np.int64(0x7FFF_FFFF_FFFF_FFFF))
            yield pa.RecordBatch.from_pydict({"g": batch.column("g"), "v": batch.column("v"), "k": pa.array(key)})

    return given.mapInArrow(make, f"g {given.schema['g'].dataType.simpleString()}, v {kind}, k long")


#: Places up to which they are broadcast; more are joined by shuffle.
MOST_BROADCAST = 200_000


def at_ranks(samples: DataFrame, group: str, value: str, ranks: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """g, which, v: the values at places of each group's order (ranks: g, which, rank from 1).

    Rounds of histograms: each counts the values that agree with the place's leading bits so far by their next bits, so no
    task holds a group; `ranks` is broadcast if it has at most that many rows.
    """
    keyed, ranks = _keyed(samples, group, value), reuse.once(ranks)
    known = F.broadcast if ranks.limit(most_broadcast + 1).count() <= most_broadcast else lambda df: df
    state, before = ranks.select("g", "which", "rank", F.lit(None).cast("long").alias("prefix")), None
    for shift in SHIFTS:
        fits = F.col("d.g").eqNullSafe(F.col("s.g"))
        if before is not None:
            fits &= F.shiftright("d.k", before) == F.col("s.prefix")
        here = keyed.alias("d").join(known(state).alias("s"), fits)
        counts = here.groupBy("s.g", "s.which", "s.rank", F.shiftright("d.k", shift).alias("prefix")).agg(F.count("*").alias("n"), F.min("d.v").alias("v"))
        upto = F.sum("n").over(Window.partitionBy("g", "which").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        state = found.select("g", "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "prefix", "v")
        before = shift
    return state.select("g", "which", "v")


def within_bounds(samples: DataFrame, group: str, value: str, places: DataFrame) -> DataFrame:
    """g, which, v: values at places (g, which, rank, lo, hi), by one pass that counts what is below lo and each value up to hi.

    A place that its bounds don't hold gives no row, so wrong bounds give no wrong value.
    """
    given = samples.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    here = given.alias("d").join(places.alias("p"), F.col("d.g").eqNullSafe(F.col("p.g")) & (F.col("d.v") <= F.col("p.hi")))
    counts = here.groupBy("p.g", "p.which", "p.rank", F.when(F.col("d.v") >= F.col("p.lo"), F.col("d.v")).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "which").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return found.where("v is not null").select("g", "which", "v")


def latency(samples: DataFrame, group: str, value: str, most_broadcast: int = MOST_BROADCAST, accuracy: int = 10_000, most_values: int = 100_000_000) -> DataFrame:
    """min, mean, median, max, sample deviation and the value at int(0.95 n) of each group.

    Two passes: the totals come with a mergeable sketch of each group, which bounds its places; the second counts between the bounds.
    Places not found there (the rank counts nulls too, so many nulls move it) and those of groups beyond `most_values`, whose values
    between bounds could be many for one window, go through the rounds of `at_ranks`.
    """
    off = 2 / accuracy
    sketch = F.percentile_approx(value, [0.95 - off, min(0.95 + off, 1.0), 0.5 - off, 0.5 + off], accuracy)
    whole = reuse.once(samples.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.count(value).alias("_m"), F.min(value).alias("min_ms"), F.round(F.avg(value), 6).alias("mean_ms"), F.max(value).alias("max_ms"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("stdev_ms"), sketch.alias("_q")))
    m = F.col("_m")
    few = m <= 2 * accuracy  # the sketch's steps are wider than the margin: all values count
    places = {"p95": (F.greatest(F.lit(1), F.floor(F.col("n") * 0.95)), 0), "low": (F.floor((m + 1) / 2), 2), "high": (F.floor(m / 2) + 1, 2)}
    each = [F.struct(F.lit(k).alias("which"), rank.cast("long").alias("rank"), F.when(few, F.col("min_ms")).otherwise(F.col("_q")[q]).alias("lo"), F.when(few, F.col("max_ms")).otherwise(F.col("_q")[q + 1]).alias("hi")) for k, (rank, q) in places.items()]
    ranks = whole.where(m > 0).select("g", "_m", F.explode(F.array(*each)).alias("x")).select("g", "_m", "x.*").where(F.col("rank") <= m)
    bounded = ranks.where(m <= most_values).drop("_m")
    if bounded.limit(most_broadcast + 1).count() <= most_broadcast:
        bounded = F.broadcast(bounded)
    values = reuse.once(within_bounds(samples, group, value, bounded))
    same = F.col("r.g").eqNullSafe(F.col("f.g")) & (F.col("r.which") == F.col("f.which"))
    left = reuse.once(ranks.alias("r").join(values.alias("f"), same, "left_anti").select("r.g", "r.which", "r.rank"))
    found = [values]
    if left.limit(1).count():
        found.append(at_ranks(samples, group, value, left, most_broadcast))
    of = lambda k: F.max(F.when(F.col("which") == k, F.col("v"))).alias(k)
    both, names = whole.alias("a"), []
    for k, df in enumerate(found):
        names.append(f"b{k}")
        both = both.join(df.groupBy("g").agg(*map(of, places)).alias(names[-1]), F.col("a.g").eqNullSafe(F.col(f"{names[-1]}.g")), "left")
    at = lambda k: F.coalesce(*[F.col(f"{b}.{k}") for b in names])
    median = 0.5 * at("low").cast("double") + 0.5 * at("high").cast("double")
    return both.select(F.col("a.g").alias(group), "n", "min_ms", "mean_ms", median.alias("median_ms"), "max_ms", "stdev_ms", at("p95").alias("p95_ms"))


def monthly_cost(savings: DataFrame, volumes: tuple[int, ...] = (1000, 10_000, 100_000), price: float = 5.0) -> DataFrame:
    """Baseline and compressed cost a month at daily volumes, from raw_tokens and post_tokens of requests."""
    mean = savings.agg(F.avg("raw_tokens").alias("raw"), F.avg("post_tokens").alias("post"))
    at = mean.select("raw", "post", F.explode(F.array(*[F.lit(v) for v in volumes])).alias("requests_per_day"))
    cost = lambda c: F.round(F.col("requests_per_day") * 30 * F.col(c) / 1e6 * price, 2)
    return at.select("requests_per_day", cost("raw").alias("baseline_usd"), cost("post").alias("compressed_usd"))


def context_losses(messages: DataFrame) -> DataFrame:
    """Messages (with content) in which the user says that the context was lost: phrase, confidence."""
    found = messages.withColumn("_s", T.context_loss(F.col("content")))
    return found.where("_s.detected").select(*messages.columns, F.col("_s.phrase").alias("phrase"), F.col("_s.confidence").alias("confidence"))


def as_of(signals: DataFrame, states: DataFrame, key: str, ts: str, columns: tuple[str, ...]) -> DataFrame:
    """signals and the columns of the latest state of their key before them (null where there is none).

    One shuffle by key: both tables in one, the last state carried forward over the order of time.
    """
    both = signals.select(key, ts, F.struct(*signals.columns).alias("_signal"), F.lit(None).cast(states.select(F.struct(*columns)).schema[0].dataType).alias("_state")).unionByName(
        states.select(key, ts, F.lit(None).cast(signals.select(F.struct(*signals.columns)).schema[0].dataType).alias("_signal"), F.struct(*columns).alias("_state"))
    )
    before = Window.partitionBy(key).orderBy(F.col(ts)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # a state at the very time of a signal comes after it
    shifted = both.withColumn(ts, F.when(F.col("_state").isNotNull(), F.col(ts).cast("timestamp") + F.expr("INTERVAL 1 MICROSECOND")).otherwise(F.col(ts).cast("timestamp")))
    found = shifted.withColumn("_last", F.last("_state", ignorenulls=True).over(before)).where("_signal is not null")
    return found.select("_signal.*", *[F.col("_last")[c].alias(f"last_{c}") for c in columns])


def loss_log(signals: DataFrame, details: DataFrame) -> DataFrame:
    """request_id, stages, removed_indices and sorted entities of the compression before each signal (details: request_id, stage, removed_index, entity)."""
    held = details.groupBy("request_id").agg(F.array_sort(F.collect_set("stage")).alias("stages"), F.array_sort(F.collect_set("removed_index")).alias("removed_indices"), F.array_sort(F.collect_set("entity")).alias("entities"))
    return signals.join(held.withColumnRenamed("request_id", "last_request_id"), "last_request_id", "left")


def last_compression(details: DataFrame, order: tuple[str, ...] = ("ts", "request_id")) -> DataFrame:
    """The latest row of every session: what a later signal of lost context is held against."""
    rest = [c for c in details.columns if c != "session_id"]
    latest = details.where("session_id is not null").groupBy("session_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return latest.select("session_id", "_last.*")


def gate_log(verdicts: DataFrame, threshold: float, mode: str = "lossy") -> DataFrame:
    """One row for each failed gate: what it measured, and that the session fell back to lossless (verdicts: columns of `quality.gated`)."""
    failed = verdicts.where("not passed")
    return failed.select("session_id", "drift_score", F.lit(threshold).alias("threshold"), "passed", "fallback_used", "recommendation", F.lit(mode).alias("mode_before"), F.lit("lossless").alias("mode_after"))


def savings_summary(events: DataFrame) -> DataFrame:
    """mode, requests and mean, least and greatest percentage saved, rounded to one digit as reports have it, and mean confidence."""
    pct = F.col("pct_saved")
    return events.groupBy(F.col("compression_mode").alias("mode")).agg(F.count("*").alias("requests"), F.round(F.avg(pct), 1).alias("mean_pct"), F.min(pct).alias("min_pct"), F.max(pct).alias("max_pct"), F.round(F.avg("confidence_score"), 4).alias("mean_confidence"))


def rolled_up_since(events: DataFrame, totals_: DataFrame | None = None) -> DataFrame:
    """Day totals with the high-water mark: events beyond each day's `last_ts` are added to what an earlier roll-up had.

    totals_: day, requests, cost_usd_saved, last_ts of the last roll-up.  An event at or before its day's mark was counted then.
    """
    dated = events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "cost_usd_saved")
    sums = (F.sum("requests").alias("requests"), F.round(F.sum("cost_usd_saved"), 6).alias("cost_usd_saved"), F.max("last_ts").alias("last_ts"))
    if totals_ is None:
        return dated.select("day", F.lit(1).cast("long").alias("requests"), "cost_usd_saved", F.col("ts").alias("last_ts")).groupBy("day").agg(*sums)
    new = dated.join(totals_.select("day", F.col("last_ts").alias("_mark")), "day", "left").where(F.col("_mark").isNull() | (F.col("ts") > F.col("_mark")))
    rows = new.select("day", F.lit(1).cast("long").alias("requests"), "cost_usd_saved", F.col("ts").alias("last_ts"))
    return totals_.select(*rows.columns).unionByName(rows).groupBy("day").agg(*sums)
