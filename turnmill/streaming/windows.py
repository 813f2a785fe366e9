"""Windows over event time; the same functions serve batch and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a timestamp (a watermark takes no timestamp_ntz)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, length: str, group: str, value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Count and sum of a value for each window and group; `late` sets a watermark, `slide` makes windows overlap."""
    base = timed(events)
    base = base.withWatermark("ts", late) if late else base
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = base.groupBy(span.alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str, user: str, late: str | None = None) -> DataFrame:
    """Runs of a user's events without a pause of `gap`."""
    base = timed(events)
    base = base.withWatermark("ts", late) if late else base
    out = base.groupBy(F.session_window("ts", gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def appended(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes a stream to Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def bounded(keep: int, path: str, order: tuple[str, ...] = ("ts", "request_id")) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last `keep` rows: each batch leaves a new version of the table beside the last."""

    def write(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{path}/v={version - 1}") if version else None
        every = batch if old is None else old.unionByName(batch)
        every.orderBy(*[F.desc(c) for c in order]).limit(keep).write.mode("overwrite").parquet(f"{path}/v={version}")

    return write
