"""Counts and times of named steps, on the driver and from tasks, and merging of such tables."""

from __future__ import annotations

import socket
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_table


class _Calls(AccumulatorParam):
    """Rows and seconds by worker."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:  # noqa: N802
        for worker, (count, seconds) in b.items():
            n, s = a.get(worker, (0, 0.0))
            a[worker] = (n + count, s + seconds)
        return a


class Diagnostics:
    """Off, it costs nothing: ``call`` and ``step`` pass on what they get."""

    def __init__(self, enabled: bool = False):
        self.enabled, self._lock = enabled, threading.Lock()
        self.reset()

    def enable(self, flag: bool = True) -> None:
        self.enabled = flag

    def reset(self) -> None:
        self.counts: dict[str, int] = {}
        self.times: dict[str, float] = {}
        self.by_worker: dict[tuple[str, str], tuple[int, float]] = {}
        self.started = time.monotonic()

    @contextmanager
    def call(self, name: str):
        """Counts and times what runs inside, failures too; does nothing when disabled."""
        began = time.monotonic()
        try:
            yield
        finally:
            if self.enabled:
                with self._lock:
                    self.counts[name] = self.counts.get(name, 0) + 1
                    self.times[name] = self.times.get(name, 0.0) + time.monotonic() - began

    def step(self, name: str, df: DataFrame) -> DataFrame:
        """``df``; when enabled, written once to a work table while its tasks count rows and the seconds they wait for them.

        So rows count once, however often later steps read the table. A task that is tried again counts once too, as Spark
        adds up what successful tasks of a job report.
        """
        if not self.enabled:
            return df
        calls = df.sparkSession.sparkContext.accumulator({}, _Calls())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, seconds, began = 0, 0.0, time.monotonic()
            for b in batches:
                rows, seconds = rows + b.num_rows, seconds + time.monotonic() - began
                yield b
                began = time.monotonic()
            calls.add({socket.gethostname(): (rows, seconds + time.monotonic() - began)})

        out = work_table(df.mapInArrow(run, df.schema), f"step-{name}")
        with self._lock:
            for worker, (count, seconds) in calls.value.items():
                n, s = self.by_worker.get((worker, name), (0, 0.0))
                self.by_worker[worker, name] = (n + count, s + seconds)
        return out

    def calls(self, spark: SparkSession) -> DataFrame:
        """(worker, name, count, time) of the steps so far, as ``totals`` takes them."""
        with self._lock:
            rows = [(w, n, c, s) for (w, n), (c, s) in self.by_worker.items()]
        return spark.createDataFrame(rows, "worker string, name string, count long, time double")

    def snapshot(self) -> dict:
        with self._lock:
            return {"counts": dict(self.counts), "times": dict(self.times), "elapsed": time.monotonic() - self.started}

    def lines(self) -> list[str]:
        s = self.snapshot()
        return [f"{k}: {s['counts'][k]} calls, {s['times'][k]:.3f} s" for k in sorted(s["counts"])]


def merged(calls: DataFrame) -> DataFrame:
    """(name, count, time) of many tables' rows added up by name."""
    return calls.groupBy("name").agg(F.sum("count").alias("count"), F.sum("time").alias("time"))


def totals(calls: DataFrame) -> DataFrame:
    """(worker, name, count, time, all_workers): calls by worker and name, and by name over all workers."""
    sums = [F.sum("count").alias("count"), F.sum("time").alias("time"), (F.grouping("worker") == 1).alias("all_workers")]
    return calls.groupingSets([["worker", "name"], ["name"]], "worker", "name").agg(*sums)
