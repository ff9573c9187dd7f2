"""Greedy folds whose next step depends on the last, with every slice of a stream in parallel.

A key's order is cut into slices by a fixed rule. What a slice does to the state that enters it is
described once, without knowing that state: greedy folds forget where they came from after a cut, so
a short description answers for every entry. The descriptions, a few numbers for each slice, are
walked along the key and give each slice the state that truly enters it; then every slice is folded
once more from there. There are three passes at any size, nothing is counted or sampled, no value
reaches the driver, and no task holds more than a slice of rows or one description at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .scan import slice_of

#: Rows of one key in order, as arrays by column name.
Rows = dict[str, np.ndarray]
#: Anything that JSON holds.
State = dict | None


@dataclass(frozen=True)
class Fold:
    """A greedy fold.

    step: rows in order and the state so far, to the output and the state after them. The output is
    tuples in the order of the fold's schema, or for `sliced_scan` an array for each added column.
    describe: what a slice does. enter: a slice's description and the state before it, to the state
    after it: the one that `step` would give. States and descriptions are what JSON holds.
    """

    step: Callable[[Rows, State], tuple[list, State]]
    describe: Callable[[Rows], dict]
    enter: Callable[[dict, State], State]


def _runs(batch: pa.RecordBatch, names: list[str]) -> list[tuple[int, int]]:
    """Bounds of the runs of rows that agree in the named columns."""
    change = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for name in names:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        change |= np.diff(codes) != 0
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    return list(zip(edges, edges[1:]))


def _along(
    batches: Iterator[pa.RecordBatch], names: list[str], values: list[str]
) -> Iterator[tuple[tuple, Rows, bool]]:
    """(group values, some of its rows, is the group new) for sorted rows.

    Missing numbers are NaN, times are datetime64 in UTC.
    """
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in values}
        runs = _runs(batch, names)
        first = pa.array([a for a, _ in runs])
        groups = zip(*(batch.column(n).take(first).to_pylist() for n in names))
        for group, (a, b) in zip(groups, runs):
            yield group, {n: v[a:b] for n, v in arrays.items()}, group != current
            current = group


class _Output:
    """Rows to hand on as Arrow batches of a schema."""

    SIZE = 1 << 14

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def full(self) -> bool:
        return len(self.rows) >= self.SIZE

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema
        )


def _columns(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _entered(
    df: DataFrame, keys: list[str], order: list[str], width: int | None, fold: Fold, uses: list[str]
) -> DataFrame:
    """The rows sorted by key, slice and order, with the state that enters their slice."""
    spark = df.sparkSession
    # Python work: as many tasks as the session plans for, not as few as the bytes suggest.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One key column that is never null, so that the join below compares it as it is shuffled, and
    # the join's own filter: with both, the two uses of the rows are one exchange.
    group = ["__key", "__slice"]
    slice_ = slice_of(df, order[0], width).cast("bigint")
    rows = (
        df.withColumns({"__key": F.struct(*keys), "__slice": slice_})
        .filter(F.col("__slice").isNotNull())
        .repartition(tasks, *group)
    )
    at = [*keys, "__slice"]
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    slice_schema = f"{key_schema}, __slice bigint"
    described = _columns(f"{slice_schema}, __text string")
    entered = _columns(f"{slice_schema}, __state string")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, open_group, held = _Output(described), None, []

        def close() -> None:
            joined = held[0] if len(held) == 1 else {
                n: np.concatenate([h[n] for h in held]) for n in uses
            }
            out.rows.append((*open_group, json.dumps(fold.describe(joined))))

        for here, part, new in _along(batches, at, uses):
            if new and held:
                close()
                held = []
                if out.full():
                    yield out.batch()
            open_group = here
            held.append(part)
        if held:
            close()
        yield out.batch()

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state = _Output(entered), None
        for here, part, new in _along(batches, keys, ["__slice", "__text"]):
            state = None if new else state
            for number, text in zip(part["__slice"].tolist(), part["__text"]):
                out.rows.append((*here, number, json.dumps(state)))
                state = fold.enter(json.loads(text), state)
            if out.full():
                yield out.batch()
        yield out.batch()

    placed = rows.sortWithinPartitions(*group, *order)
    states = (
        placed.mapInArrow(describe, f"{slice_schema}, __text string")
        .repartition(tasks, *keys).sortWithinPartitions(*at)
        .mapInArrow(enter, f"{slice_schema}, __state string")
        .select(F.struct(*keys).alias("__key"), "__slice", "__state")
    )
    return rows.join(states, group).sortWithinPartitions(*group, *order)


def sliced_fold(
    df: DataFrame, keys: list[str], order: list[str], width: int | None, fold: Fold, schema: str
) -> DataFrame:
    """The fold over the rows of each key along `order`, whose leading column is a number, a date or
    a time; rows without one take no part.

    ``schema`` lists the columns after the keys. ``width`` is that of a slice in numbers, days or
    seconds of the leading column, and bounds what a task holds of a key. Rows are shuffled once, by
    key and slice; descriptions are shuffled by key.
    """
    uses = [c for c in df.columns if c not in keys]
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    result = _columns(f"{key_schema}, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state = _Output(result), None
        # The state, the same on all rows of a slice, is among the names so as to be read once.
        for here, part, new in _along(batches, [*keys, "__slice", "__state"], uses):
            if new:
                state = json.loads(here[-1])
            done, state = fold.step(part, state)
            out.rows.extend((*here[:-2], *row) for row in done)
            if out.full():
                yield out.batch()
        yield out.batch()

    rows = _entered(df, keys, order, width, fold, uses)
    return rows.mapInArrow(run, f"{key_schema}, {schema}")


def sliced_scan(
    df: DataFrame, keys: list[str], order: list[str], width: int | None, fold: Fold, uses: list[str],
    schema: str,
) -> DataFrame:
    """The rows of ``df`` with the columns of ``schema``, for which the fold's step gives arrays.

    The step reads the columns in ``uses``; all others stay as they are. Otherwise as `sliced_fold`.
    """
    columns = df.columns
    added = _columns(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = state = None
        for batch in batches:
            parts: list[list] = []
            for here, part, _ in _along(iter([batch]), [*keys, "__slice", "__state"], uses):
                if here != current:
                    current, state = here, json.loads(here[-1])
                done, state = fold.step(part, state)
                parts.append(done)
            if parts:
                made = [
                    pa.array(np.concatenate(c), f.type, from_pandas=True)
                    for c, f in zip(zip(*parts), added)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), *made], [*columns, *added.names]
                )

    rows = _entered(df, keys, order, width, fold, uses)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(run, f"{fields}, {schema}")
