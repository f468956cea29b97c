"""A user's own aggregate in two phases: partial states in each task, merged after the shuffle."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

#: Keys whose partial states a task holds before it passes them on.
HELD = 50_000


class Aggregate:
    """What a user writes: states are any values that pickle; `returns` is the type of the result, as in a schema."""

    returns = "double"

    def init(self) -> Any:
        raise NotImplementedError

    def update(self, state: Any, *values: list) -> Any:
        """The state with the values of some rows, a list for each column."""
        raise NotImplementedError

    def merge(self, one: Any, two: Any) -> Any:
        raise NotImplementedError

    def finish(self, state: Any) -> Any:
        raise NotImplementedError


def _key_columns(batch: pa.RecordBatch, n: int) -> list[tuple]:
    return list(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True)) if n else [()] * batch.num_rows


def aggregate(df: DataFrame, keys: list[str], columns: list[str], agg: Aggregate, name: str = "value") -> DataFrame:
    """(keys, name): `agg` over the rows of each key, of which nulls are one; without keys one row, of no rows too.

    A task folds its rows by key as Arrow batches come and passes on a state per key, whenever it holds HELD of them; states
    are shuffled by key, sorted, and merged as they stream by. A hot key is one state per task before the shuffle.
    """
    n = len(keys)
    rows = df.select(*keys, *columns)
    key_fields = list(rows.schema)[:n]
    partial = StructType([*key_fields, StructField("state", BinaryType(), False)])
    final = StructType([*key_fields, *StructType.fromDDL(f"`{name}` {agg.returns}")])
    partial_arrow, final_arrow = to_arrow_schema(partial), to_arrow_schema(final)

    def out(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        flush = lambda: out([(*k, pickle.dumps(s)) for k, s in states.items()], partial_arrow)
        for b in batches:
            at: dict[tuple, list[int]] = {}
            for i, k in enumerate(_key_columns(b, n)):
                at.setdefault(k, []).append(i)
            for k, places in at.items():
                part = b.take(pa.array(places)) if len(places) < b.num_rows else b
                states[k] = agg.update(states[k] if k in states else agg.init(), *(part.column(n + j).to_pylist() for j in range(len(columns))))
            if len(states) >= HELD:
                yield flush()
                states.clear()
        yield flush()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, done = None, None, []
        for b in batches:
            for k, s in zip(_key_columns(b, n), b.column(n).to_pylist(), strict=True):
                if state is not None and k == held:
                    state = agg.merge(state, pickle.loads(s))
                    continue
                if held is not None:
                    done.append((*held, agg.finish(state)))
                held, state = k, pickle.loads(s)
            if done:
                yield out(done, final_arrow)
                done = []
        if held is not None:
            done.append((*held, agg.finish(state)))
        elif not n:
            done.append((agg.finish(agg.init()),))
        yield out(done, final_arrow)

    states = rows.mapInArrow(fold, partial)
    if not n:
        # each task has one state left; these meet in one
        return states.repartition(1).mapInArrow(combine, final)
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(combine, final)
