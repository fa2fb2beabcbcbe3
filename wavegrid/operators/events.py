"""Operators on event tables: onsets, differences, overlapping responses."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_table
from .facts import crowded, with_facts

#: Samples that one row of a continuous signal holds.
BLOCK = 1024


def delta_latency(df: DataFrame, by: Sequence[str], order: Sequence[str], latency: str = "latency", spread: bool | None = None) -> DataFrame:
    """``dlatency``: the next event's latency less this one's; 0 for the last of a run, and where either is null.

    Many small runs are ordered by a window. With ``spread`` (unless told, where a run is larger than a task should take; where
    ``by`` is empty, always) rows are sorted in ranges over all tasks, each of which looks one row ahead as a stream; the
    first row of the next range is known to the last row of a range, from a table of one row for each range.
    """
    by = list(by)
    if by and not (crowded(df, by) if spread is None else spread):
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("dlatency", F.coalesce(F.lead(latency).over(w) - F.col(latency), F.lit(0).cast("long")))
    in_order = _in_ranges(df, by, order).withColumn("_at", F.col(latency).cast("long"))
    schema = in_order.withColumns({"_next": F.lit(None).cast("long"), "_range": F.lit(0), "_head": F.lit(True), "_tail": F.lit(True)}).schema
    local = work_table(in_order.mapInArrow(_local_next(by), schema), "next")
    after = Window.orderBy("_range")  # over one row for each range
    heads = local.where("_head").select((F.lag("_range").over(after)).alias("_range"), *by, F.col("_at").alias("_follows")).where("_range IS NOT NULL")
    tails = with_facts(local.where("_tail"), F.broadcast(heads), ["_range", *by], "left").withColumn("_next", F.coalesce("_next", "_follows")).drop("_follows")
    known = local.where("NOT _tail").unionByName(tails)
    return known.withColumn("dlatency", F.coalesce(F.col("_next") - F.col("_at"), F.lit(0).cast("long"))).select(*[c for c in df.columns if c != "dlatency"], "dlatency")


def _in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(ranges, *by, *order).sortWithinPartitions(*by, *order)


def _local_next(by: list[str]):
    """Sorted rows with the next one's ``_at``, if it is of the same run; the range's first and last row are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, head = TaskContext.get().partitionId(), None, True

        def told(b: pa.RecordBatch, following: pa.Array, first: bool, last: bool) -> pa.RecordBatch:
            heads, tails = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, bool)
            heads[0], tails[-1] = first, last
            more = {"_next": following, "_range": pa.array(np.full(b.num_rows, at, np.int32)), "_head": pa.array(heads), "_tail": pa.array(tails)}
            columns = {c: b.column(c) for c in b.schema.names} | more
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([held, b] if held is not None else [b]).combine_chunks().to_batches()[0]
            if rows.num_rows > 1:
                following = pc.if_else(pa.array(~_new_runs(rows, by)[1:]), rows.column("_at").slice(1), pa.scalar(None, pa.int64()))
                yield told(rows.slice(0, rows.num_rows - 1), following, head, False)
                head = False
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield told(held, pa.nulls(1, pa.int64()), head, True)

    return run


def onsets(df: DataFrame, by: Sequence[str], order: Sequence[str], gap: Column, spread: bool | None = None) -> DataFrame:
    """``latency``: the running sum of gaps; null gaps add nothing.

    Many small runs are summed by a window. With ``spread`` (see ``delta_latency``) a run may have any share of the table.
    """
    if by and not (crowded(df, by) if spread is None else spread):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("latency", F.sum(F.coalesce(gap.cast("long"), F.lit(0).cast("long"))).over(w))
    return running_sum(df, by, order, gap, "latency")


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``name``: the running sum of whole numbers in each run, whose rows may be any share of the table.

    Rows are sorted in ranges over all tasks, and a task adds up what its range holds of each run, as a stream. What a run has
    in earlier ranges is added at last: of the runs of a range, only the first one can have begun before.
    """
    by, order = list(by), list(order)
    rows = df.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    in_order = _in_ranges(rows, by, order)
    schema = in_order.withColumns({name: F.lit(0).cast("long"), "_range": F.lit(0)}).schema
    local = work_table(in_order.mapInArrow(_local_sums(by, name), schema), "sums")
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = local.groupBy("_range", *by).agg(F.sum("_value").alias("_total")).withColumn("_before", F.sum("_total").over(earlier))
    before = before.where("_before IS NOT NULL").select("_range", *by, "_before")  # a row for each range at most
    known = with_facts(local, F.broadcast(before), ["_range", *by], "left")
    return known.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*[c for c in df.columns if c != name], name)


def _new_runs(b: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Where a row's run is not that of the row before; false for the first row."""
    new = np.zeros(b.num_rows, bool)
    for c in by:
        here, there = b.column(c).slice(1), b.column(c).slice(0, b.num_rows - 1)
        differs = pc.fill_null(pc.not_equal(here, there), False).to_numpy(zero_copy_only=False)
        new[1:] |= differs | (here.is_null().to_numpy(zero_copy_only=False) != there.is_null().to_numpy(zero_copy_only=False))
    return new


def _local_sums(by: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, run_, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            values, new = b.column("_value").to_numpy(), _new_runs(b, by)
            begun = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            sums = np.cumsum(values)
            sums = sums - (sums - values)[begun]
            if [b.column(c)[0].as_py() for c in by] == run_:
                sums[begun == 0] += total
            run_, total = [b.column(c)[-1].as_py() for c in by], int(sums[-1])
            columns = {c: b.column(c) for c in b.schema.names} | {name: pa.array(sums), "_range": pa.array(np.full(len(sums), at, np.int32))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def overlap_add(df: DataFrame, by: Sequence[str], response: str = "response") -> DataFrame:
    """(by, sample, value): all responses of a run added up, each from its latency on."""
    cells = df.select(*by, "latency", F.posexplode(response).alias("i", "v"))
    return cells.groupBy(*by, (F.col("latency") + F.col("i")).alias("sample")).agg(F.sum("v").alias("value"))


def epochs(df: DataFrame, by: Sequence[str], n_time: Column, response: str = "response") -> DataFrame:
    """``signal``: the overlapped signal from each event's latency on, ``n_time`` samples; zero beyond its end.

    The signal is kept as rows of ``BLOCK`` samples, so an event meets a few rows instead of one for each sample.
    """
    by = list(by)
    added = overlap_add(df, by, response).withColumn("block", F.floor(F.col("sample") / BLOCK))
    blocks = added.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct((F.col("sample") - F.col("block") * BLOCK).cast("int").alias("k"), "value"))).alias("cells"))
    last = F.floor((F.col("latency") + n_time - 1) / BLOCK)
    wanted = df.withColumn("block", F.explode(F.sequence(F.floor(F.col("latency") / BLOCK), last)))
    joined = wanted.join(blocks, [*by, "block"])
    inside = lambda c: (c["k"] >= F.col("latency") - F.col("block") * BLOCK) & (c["k"] < F.col("latency") + n_time - F.col("block") * BLOCK)
    part = F.transform(F.filter("cells", inside), lambda c: F.struct((c["k"] + F.col("block") * BLOCK - F.col("latency")).cast("int").alias("t"), c["value"].alias("v")))
    keys = [*by, "trial"]
    parts = joined.select(*keys, part.alias("part")).groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("part"))
    out = df.join(parts, keys, "left")
    # between two events' responses there can be silence; only then are samples missing
    dense = F.transform("part", lambda c: c["v"])
    sparse = F.transform(F.sequence(F.lit(0), n_time.cast("int") - 1), lambda t: F.coalesce(F.get(F.filter("part", lambda c: c["t"] == t), F.lit(0))["v"], F.lit(0.0)))
    return out.withColumn("signal", F.when(F.size("part") == n_time, dense).otherwise(sparse)).drop("part")
