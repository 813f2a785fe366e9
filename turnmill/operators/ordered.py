"""Folds over the rows of every key in order, also where one key holds most of the rows.

Rows are dealt out by ranges of key and order, so a partition holds a run of the whole order and a
hot key spans several.  A partition that lies within one key is summed up as what it makes of any
state (a transition); the states at the partitions' begins follow from these by going through the
partitions once, one small row each; then all partitions are walked at once.
"""

from __future__ import annotations

import pickle
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import reuse


class Fold(Protocol):
    """How a state moves over a key's rows."""

    #: The columns that `move` takes, and those it gives.
    takes: tuple[str, ...]
    gives: list[StructField]

    def begin(self) -> Any:
        """The state before a key's first row."""

    def move(self, state: Any, *values: Any) -> tuple[Any, tuple]:
        """The state after a row, and the row's outputs."""

    def transition(self) -> Any:
        """An object with add(*values) for a row and of(state), the state after all rows added."""


def _columns(batch: pa.RecordBatch, key: str, fold: Fold):
    return zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in fold.takes), strict=True)


def _ends(placed: DataFrame, key: str, fold: Fold) -> DataFrame:
    """A row for each partition: its first and last key, whether it is one key's, and the state (or pickled transition) at its end."""

    def sum_up(batches):
        part, first, last, single, state, over = None, None, None, True, None, None
        for batch in batches:
            if batch.num_rows and part is None:
                part = batch.column("_part")[0].as_py()
                first = last = batch.column(key)[0].as_py()
                over = fold.transition()
            for k, *values in _columns(batch, key, fold):
                if k != last:
                    last, single, state = k, False, fold.begin()
                if single:
                    over.add(*values)
                else:
                    state, _ = fold.move(state, *values)
        if part is not None:
            # keys are compared as they were pickled, whatever their type
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [pickle.dumps(first)], "last": [pickle.dumps(last)], "single": [single], "end": [pickle.dumps(over if single else state)]})

    return placed.mapInArrow(sum_up, "part int, first binary, last binary, single boolean, end binary")


def _begins(ends: DataFrame, fold: Fold) -> DataFrame:
    """part, begin: the pickled state before a partition's first row."""

    def chain(batches):
        key, state = object(), None
        for batch in batches:
            for row in batch.to_pylist():
                first, end = pickle.loads(row["first"]), pickle.loads(row["end"])
                begin = state if first == key else fold.begin()
                key, state = pickle.loads(row["last"]), end.of(begin) if row["single"] else end
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]], pa.int32()), "begin": [pickle.dumps(begin)]})

    # one row a partition: a task's worth whatever the data's size
    return ends.repartition(1).sortWithinPartitions("part").mapInArrow(chain, "part int, begin binary")


def folded(rows: DataFrame, key: str, order: list[Column], fold: Fold) -> DataFrame:
    """rows with the outputs of the fold over each key's rows in order (which must leave no ties)."""
    ordered = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    placed = reuse.once(ordered.withColumn("_part", F.spark_partition_id()))
    begins = _begins(_ends(placed.select(key, *dict.fromkeys(c for c in fold.takes if c != key), "_part"), key, fold), fold)
    columns, gives = rows.columns, [(f.name, _ARROW[f.dataType.simpleString()]) for f in fold.gives]
    known = placed.join(F.broadcast(begins), F.col("_part") == F.col("part"))  # as many rows as partitions

    def walk(batches):
        last, state, started = None, None, False
        for batch in batches:
            if batch.num_rows and not started:
                last, state, started = batch.column(key)[0].as_py(), pickle.loads(batch.column("begin")[0].as_py()), True
            made = []
            for k, *values in _columns(batch, key, fold):
                if k != last:
                    last, state = k, fold.begin()
                state, out = fold.move(state, *values)
                made.append(out)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | {name: pa.array([m[n] for m in made], kind) for n, (name, kind) in enumerate(gives)})

    return known.mapInArrow(walk, StructType([*rows.schema.fields, *fold.gives]))


_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
