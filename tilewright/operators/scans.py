"""Order-dependent folds as scans over ranges: a group may be cut anywhere, so none needs a task of its own.

Rows are ranged by (group, order) and each range is folded once, in a stream.  A range's first group may have begun in
an earlier range, with a state that is not known there.  So its rows carry their answers for every state it can have had,
as long as these differ, and the range's last row carries what the range makes of each of them.  These last rows, one
for each range, are then followed in order, which gives every range's true first state; answers are picked by it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..scratch import materialize


class Known(Protocol):
    """The state of a group from its beginning."""

    def step(self, *values: Any) -> Any: ...
    def end(self) -> Any: ...


class Open(Protocol):
    """A group's state where it began earlier: ``step`` gives (answer, None) once that does not depend on the state
    before, else (None, answers by state); ``end`` tells what becomes of each state."""

    def step(self, *values: Any) -> tuple[Any, Any]: ...
    def end(self) -> Any: ...


class Fold(Protocol):
    """``columns``: what a step reads.  ``answer`` and ``cases``: types of an answer, and of answers by state.  States are
    whole numbers; ``first`` is a group's before its first row."""

    columns: tuple[str, ...]
    answer: str
    cases: str

    def begin(self) -> Known: ...
    def unknown(self) -> Open: ...
    def resume(self, end: Any, start: int) -> int:
        """The state after a range, from what its open state ended with and the state before."""

    def first(self) -> int: ...
    def pick(self, cases: Column, start: Column) -> Column: ...
    def prepare(self, columns: list[pa.Array]) -> list[list]:
        """The values of a batch's rows, column by column."""


def _name(batch: pa.RecordBatch, group: list[str], row: int) -> str:
    return repr([batch.column(c)[row].as_py() for c in group])


def _changes(batch: pa.RecordBatch, group: list[str]) -> list[int]:
    """Rows at which another group begins, the first row left out; nulls are equal to each other."""
    at: set[int] = set()
    for c in group:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        at.update((codes[1:] != codes[:-1]).nonzero()[0].tolist())
    return sorted(k + 1 for k in at)


def _fold_ranges(fold: Fold, group: list[str], schema: list[str], answer: pa.DataType, cases: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, current, state, was_open, held = TaskContext.get().partitionId(), None, None, None, True, None

        def made(batch: pa.RecordBatch, answers: list, by_state: list, exit_: str | None) -> pa.RecordBatch:
            n = batch.num_rows
            extra = [pa.array(answers, type=answer), pa.array(by_state, type=cases), pa.array([part] * n, type=pa.int32()), pa.array([None] * (n - 1) + [exit_], type=pa.string())]
            return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield made(*held, None)
            answers, by_state = [], []
            values = fold.prepare([batch.column(c) for c in fold.columns])
            starts = [0, *_changes(batch, group), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:]):
                name = _name(batch, group, a)
                if first is None:
                    first = current = name
                    state = fold.unknown()
                elif name != current:
                    current, state, was_open = name, fold.begin(), False
                rows = zip(*(v[a:b] for v in values))
                if was_open:
                    for row in rows:
                        told, cases_ = state.step(*row)
                        answers.append(told)
                        by_state.append(cases_)
                else:
                    step = state.step
                    answers.extend(step(*row) for row in rows)
                    by_state.extend([None] * (b - a))
            held = (batch, answers, by_state)
        if held is not None:
            yield made(*held, json.dumps({"first": first, "last": current, "open": was_open, "end": state.end()}))

    return run


def _follow(fold: Fold):
    """Summaries in the order of ranges to each range's first state: one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, fold.first()
        for batch in batches:
            parts, starts = batch.column("__part").to_pylist(), []
            for text in batch.column("__exit").to_pylist():
                told = json.loads(text)
                starts.append(state if told["first"] == last else fold.first())
                state = fold.resume(told["end"], starts[-1]) if told["open"] else told["end"]
                last = told["last"]
            yield pa.RecordBatch.from_arrays([pa.array(parts, type=pa.int32()), pa.array(starts, type=pa.int64())], names=["__part", "__start"])

    return run


def scan(df: DataFrame, fold: Fold, name: str, group: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Adds ``name``: the fold's answer for each row, groups in ``order``.  Null groups are one group; a null in ``order``
    comes first.  Rows equal in group and order are folded in any order.  Columns ``__part``, ``__start``, ``__exit``,
    ``__answer`` and ``__cases`` are taken."""
    spark = df.sparkSession
    parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = df.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    extra = ["__answer", "__cases", "__part", "__exit"]
    kinds = to_arrow_schema(StructType.fromDDL(f"a {fold.answer}, c {fold.cases}"))
    run = _fold_ranges(fold, group, [*df.columns, *extra], kinds.field("a").type, kinds.field("c").type)
    folded = materialize(ranged.mapInArrow(run, f"{fields}, __answer {fold.answer}, __cases {fold.cases}, __part int, __exit string"), "folded")
    ends = folded.where("__exit is not null").select("__part", "__exit").repartition(1).sortWithinPartitions("__part")
    starts = ends.mapInArrow(_follow(fold), "__part int, __start long")
    joined = folded.join(F.broadcast(starts), "__part", "left")  # one row for each range
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col("__answer"), fold.pick(F.col("__cases"), F.col("__start"))).alias(name))

