"""Means and deviations of array columns, element by element, from states that merge."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import matrix_of

#: Groups whose states a task holds before it sends them on.
HELD = 10_000

#: For each element: number, mean, sum of squared distances from the mean.
State = tuple[np.ndarray, np.ndarray, np.ndarray]


def state_of(a: np.ndarray, valid: np.ndarray) -> State:
    """Of rows of values, of which only the valid ones count."""
    n = valid.sum(0)
    mean = np.divide(np.where(valid, a, 0.0).sum(0), n, out=np.zeros(len(n)), where=n > 0)
    # a second look removes what the mean lost to rounding
    apart = np.where(valid, a - mean, 0.0)
    shift = np.divide(apart.sum(0), n, out=np.zeros(len(n)), where=n > 0)
    return n, mean + shift, (np.where(valid, apart - shift, 0.0) ** 2).sum(0)


def merged(a: State, b: State) -> State:
    """Of both together; the shorter one is filled up with elements without values."""
    size = max(len(a[0]), len(b[0]))
    (na, ma, qa), (nb, mb, qb) = ([np.pad(x, (0, size - len(x))) for x in s] for s in (a, b))
    n = na + nb
    share = np.divide(nb, n, out=np.zeros(size), where=n > 0)
    return n, ma + (mb - ma) * share, qa + qb + (mb - ma) ** 2 * na * share


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([r.tolist() for r in rows], pa.list_(kind))


def _batch(keys: list[tuple], states: list[State], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = [pa.array([k[j] for k in keys], f.type) for j, f in enumerate(fields)]
    parts = [_lists([s[j] for s in states], kind) for j, kind in enumerate((pa.int64(), pa.float64(), pa.float64()))]
    return pa.RecordBatch.from_arrays([*columns, *parts], names=[*[f.name for f in fields], "n", "mean", "squares"])


def _keys(b: pa.RecordBatch, by: list[str]) -> list[tuple]:
    return list(zip(*(b.column(c).to_pylist() for c in by))) if by else [()] * b.num_rows


def _states(by: list[str], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, State] = {}
        fields: list[pa.Field] = []
        for b in batches:
            fields = [b.schema.field(c) for c in by]
            rows: dict[tuple, list[int]] = {}
            for k, key in enumerate(_keys(b, by)):
                rows.setdefault(key, []).append(k)
            a, valid, length = matrix_of(b.column(column))
            for key, at in rows.items():
                width = length[at].max()
                state = state_of(a[at, :width], valid[at, :width])
                held[key] = merged(held[key], state) if key in held else state
            if len(held) > HELD:
                yield _batch(list(held), list(held.values()), fields)
                held = {}
        if held:
            yield _batch(list(held), list(held.values()), fields)

    return run


def _merged_states(by: list[str]):
    """States sorted by group: one for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, fields = None, None, []
        for b in batches:
            fields, done = [b.schema.field(c) for c in by], []
            for k, *state in zip(_keys(b, by), *(b.column(c).to_pylist() for c in ("n", "mean", "squares"))):
                new = tuple(map(np.array, state))
                if held is not None and k != key:
                    done.append((key, held))
                    held = None
                key, held = k, new if held is None else merged(held, new)
            if done:
                yield _batch(*map(list, zip(*done)), fields)
        if held is not None:
            yield _batch([key], [held], fields)

    return run


def moments(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, deviation), arrays: of each element of ``column`` in each group; the sample's deviation, null for one value.

    Nulls are left out. A task sends one state for each group, of the arrays' length, so nothing is shuffled in long form.
    """
    by = list(by)
    rows = df.select(*by, F.col(column).cast("array<double>").alias(column))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema.fields)
    schema = f"{kinds}n array<long>, mean array<double>, squares array<double>"
    states = rows.where(F.size(column) > 0).mapInArrow(_states(by, column), schema)
    states = states.repartition(*by).sortWithinPartitions(*by) if by else states.repartition(1)
    one = states.mapInArrow(_merged_states(by), schema)
    deviation = F.transform(F.arrays_zip("n", "squares"), lambda x: F.when(x["n"] > 1, F.sqrt(x["squares"] / (x["n"] - 1))))
    mean = F.transform(F.arrays_zip("n", "mean"), lambda x: F.when(x["n"] > 0, x["mean"]))
    return one.select(*by, "n", mean.alias("mean"), deviation.alias("deviation"))
