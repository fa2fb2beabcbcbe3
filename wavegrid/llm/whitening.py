"""Embedding whitening by hierarchical SVD merging.

A vector's entries c become whole numbers floor(64 * c) + 1000000. Each distinct whole-number vector counts once: a state
of some of them is their number, their exact sums, and all singular values and right singular vectors of the centred
vectors. Two states merge without loss: the rows s * V of both and one row that corrects for the distance of their means
have the singular values and vectors of the union. Tasks merge states of batches, and rounds of groups merge the states of
tasks until one is left, whose squared singular values over n are the covariance's eigenvalues.

Values are taken relative to the offset and to exact sums, so nothing large is subtracted in floating point. A second
pass measures the whitened vectors' own covariance, again by merging centred states. States have the size of a square of
the dimensions, whatever the number of rows; the driver gets the last one only.

Defined results: a row whose vector is null or holds null or non-finite entries has no result; an empty vector has no
component, and vectors of different lengths are matrices of their own. ``whitened`` is null for a component without variance
(``explained`` is 0, null where nothing varies); ``deviation`` is null where it doesn't fit a long. Rows with a null vec_id and
repeated rows are kept, the latter each with its result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: States that one task merges in a round.
FANOUT = 16
#: Eigenvalues up to this share of the greatest, the square of some hundred rounding errors, are none.
NEGLIGIBLE = 1e-27
#: Entries from here on raise an error, as sums of their whole numbers may not fit a long.
LIMIT = 1 << 31
_STATE = "size long, at long, n long, sums array<long>, values array<double>, vectors array<double>"

#: (n, exact sums relative to the offset, singular values, right singular vectors) of centred rows.
State = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def whole_numbers(rows: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is whole."""
    finite = F.forall("embedding", lambda c: F.coalesce(c.cast("double").isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    large = F.raise_error(F.lit(f"an entry is {LIMIT} or more")).cast("long")
    x = F.transform("embedding", lambda c: F.when(F.abs(c) < LIMIT, F.floor(SCALE * c.cast("double")) + OFFSET).otherwise(large))
    return rows.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def state_of(x: np.ndarray) -> State:
    """Of rows of whole numbers."""
    near = x - OFFSET
    sums = near.sum(0)
    centred = (len(x) * near - sums) / len(x)
    return len(x), sums, *_factors(centred)


def _factors(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right singular vectors; the rotation alone where there are more rows than columns."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s, v


def merged(a: State, b: State) -> State:
    (na, sa, va, ra), (nb, sb, vb, rb) = a, b
    apart = sa / na - sb / nb
    rows = np.concatenate([va[:, None] * ra, vb[:, None] * rb, np.sqrt(na * nb / (na + nb)) * apart[None, :]])
    return na + nb, sa + sb, *_factors(rows)


def _matrices(b: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each vector length of a batch, and their matrix."""
    values, offsets = C.ragged(b.column(column))
    length = np.diff(offsets)
    for d in np.unique(length).tolist():
        if d:
            at = np.flatnonzero(length == d)
            yield at, values.view(np.int64)[offsets[at][:, None] + np.arange(d)]


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of a task's vectors, for each length."""
    from pyspark import TaskContext

    held: dict[int, State] = {}
    for b in batches:
        for _, x in _matrices(b, "x"):
            state, d = state_of(x), x.shape[1]
            held[d] = merged(held[d], state) if d in held else state
    for d, state in held.items():
        yield _row(d, TaskContext.get().partitionId(), state)


def _row(d: int, at: int, state: State) -> pa.RecordBatch:
    n, sums, values, vectors = state
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    arrays = [pa.array([d]), pa.array([at]), pa.array([n]), pa.array([sums], longs), pa.array([values], doubles), pa.array([vectors.ravel()], doubles)]
    return pa.RecordBatch.from_arrays(arrays, names=["size", "at", "n", "sums", "values", "vectors"])


def _read(row: dict) -> State:
    """A state has as many vectors as values, each of the states' own number of columns."""
    values = np.array(row["values"], float)
    return row["n"], np.array(row["sums"], np.int64), values, np.array(row["vectors"], float).reshape(len(values), len(row["sums"]))


def _merge_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States sorted by length and group: one for each."""
    key, held = None, None
    for b in batches:
        for row in b.to_pylist():
            state, at = _read(row), (row["size"], row["at"])
            if held is not None and at != key:
                yield _row(*key, held)
                held = None
            key, held = at, state if held is None else merged(held, state)
    if held is not None:
        yield _row(*key, held)


def last_states(states: DataFrame, tasks: int, fanout: int = FANOUT) -> dict[int, State]:
    """The merged state of each vector length, after rounds in which a task merges ``fanout`` states of a length at most."""
    while tasks > 1:
        tasks = -(-tasks // fanout)
        grouped = states.withColumn("at", F.floor(F.col("at") / fanout).cast("long"))
        states = grouped.repartition("size", "at").sortWithinPartitions("size", "at").mapInArrow(_merge_group, _STATE)
    found: dict[int, State] = {}
    for row in C.saved(states).toLocalIterator():
        state = _read(row.asDict())
        found[row["size"]] = merged(found[row["size"]], state) if row["size"] in found else state
    return found


class Model:
    """n, exact sums relative to the offset, and the leading eigenvectors and eigenvalues of the covariance."""

    def __init__(self, state: State, components: int = COMPONENTS):
        self.n, self.sums, values, vectors = state
        e, d = np.zeros(len(self.sums)), len(self.sums)
        e[: len(values)] = values**2 / self.n
        e[e <= NEGLIGIBLE * e.max()] = 0
        basis = np.linalg.qr(vectors.T, mode="complete")[0].T if len(vectors) < d else vectors
        basis[: len(vectors)] = vectors
        self.e, self.basis, self.trace = e[:components], basis[:components], e.sum()

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * (x - OFFSET) - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Not-a-number for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (self.numerators(x) / self.n) @ self.basis.T / np.sqrt(self.e)
        out[:, self.e == 0] = np.nan
        return out

    def deviation(self, x: np.ndarray) -> list[int | None]:
        k = self.numerators(x)
        rough = (k.astype(float) ** 2).sum(1)
        safe = rough < 9.2e18
        exact = (np.where(safe[:, None], k, 0) ** 2).sum(1)
        return [v if ok else None for v, ok in zip(exact.tolist(), safe.tolist())]


def fit(vectors: DataFrame, components: int = COMPONENTS, fanout: int = FANOUT) -> dict[int, Model]:
    """The model of each vector length of a table of distinct vectors ``x``."""
    states = C.work_table(vectors.mapInArrow(_states, _STATE), "states")
    return {d: Model(s, components) for d, s in last_states(states, _tasks(states), fanout).items()}


def _tasks(states: DataFrame) -> int:
    """States are numbered below this."""
    return (states.agg(F.max("at")).first()[0] or 0) + 1


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Of each length the largest absolute entry of the whitened distinct vectors' covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _matrices(b, "x"):
                z = models[x.shape[1]].whitened(x)  # of centred vectors, so centred itself
                held[x.shape[1]] = held.get(x.shape[1], 0) + z.T @ z
        for d, total in held.items():
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d)), pa.array(np.arange(len(flat))), pa.array(flat)], names=["size", "cell", "total"])

    totals = vectors.mapInArrow(run, "size long, cell long, total double").groupBy("size", "cell").agg(F.sum("total").alias("total"))
    errors: dict[int, float] = {}
    for r in totals.toLocalIterator():  # a square of the components for each length
        m = models[r["size"]]
        i, j = divmod(r["cell"], len(m.e))
        if m.e[i] and m.e[j]:
            errors[r["size"]] = max(errors.get(r["size"], 0.0), abs(r["total"] / m.n - (i == j)))
    return errors


def whitened(rows: DataFrame, components: int = COMPONENTS, fanout: int = FANOUT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and leading component."""
    C.small_batches(rows.sparkSession)
    x = whole_numbers(rows)
    vectors = C.work_table(x.select("x").distinct(), "vectors")
    models = fit(vectors, components, fanout)
    errors = identity_errors(vectors, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _matrices(b, "x"):
                m = models[x.shape[1]]
                k, share = len(m.e), m.e / m.trace if m.trace else [None] * len(m.e)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                ids, deviation = b.column("vec_id").take(pa.array(at)), pa.array(m.deviation(x), pa.int64())
                values = pa.array(m.whitened(x).ravel(), from_pandas=True)
                error = pa.array([errors.get(x.shape[1])] * len(each), pa.float64())
                arrays = [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), m.n)), deviation.take(each), values, pa.array(list(share) * len(x), pa.float64()), error]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(C.table(spark, sf_dir, "embeddings"))
