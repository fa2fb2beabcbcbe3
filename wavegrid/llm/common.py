"""Shared pieces of the training-data operators: word splitting, hashing, packed rows, work tables.

Conventions that hold for every operator here:

* a *word* is a maximal run of ``[^\\x20\\x09-\\x0D]``; a null text has no words;
* rows whose ``doc_id`` is null are left out, since a result row could not name them;
* only ``doc_id`` and ``text`` are read, so extra columns never clash;
* rows that repeat a ``doc_id`` with the same text get equal result rows; where its texts differ, each row has a
  result of its own, and where an operator asks for the smaller doc_id they count as one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, work_table  # noqa: F401

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch; keeps a batch of long documents within a Python worker's memory.
BATCH_ROWS = 500
#: Odd multipliers of the polynomial and of the finishing mix (fixed values).
POLY = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """The two columns that operators read, with a text that is never null."""
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def word_hashes(text: Column) -> Column:
    """64-bit hash of each word, made inside the JVM."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def unused(name: str, columns: list[str]) -> str:
    """``name``, longer where a column is already called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def saved(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint, for small tables of iterative steps."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: sizes the groups of later stages, so that each fits a task."""
    return docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of each ``k`` consecutive hashes; entries that cross documents are the caller's to skip."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * POLY + h[j : j + n]
    return mix(out)


def ragged(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat uint64 values and offsets (from 0) of an Arrow list<int64> column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(offsets) else np.zeros(0)
    return values.astype(np.int64, copy=False).view(np.uint64), offsets - offsets[0]


def starts(offsets: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which flat positions begin ``k`` words of one document."""
    ok = np.zeros(total, bool)
    length = np.diff(offsets)
    many = length >= k
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, offsets[:-1][many], 1)
    np.add.at(step, (offsets[1:] - k + 1)[many], -1)
    ok[:] = np.cumsum(step[:-1]) > 0
    return ok


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Batches gathered until ``column`` (a list) holds ``limit`` values, so memory stays bounded."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b.column(column).flatten())
        if n >= limit:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values, and each position's run number."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def gathered(starts_: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the slices ``[start, start + length)`` laid one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts_ - (ends - lengths), lengths)
