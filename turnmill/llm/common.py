"""Tables in the cluster's shared folder, and rows as structs that no column name can clash with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as in the contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of this machine's own, if driver and executors are this machine (local mode)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="turnmill-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Writes a table into the shared folder (zstd of that level) and reads it again: lineage ends here, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/turnmill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(df["text"], F.lit(""))


def cores(spark: SparkSession) -> int:
    """Tasks that run at once."""
    return max(1, spark.sparkContext.defaultParallelism)


def row_of(df: DataFrame) -> Column:
    """All columns in one struct: beside it no name of an operator's own can clash with theirs."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
