"""Operators on trials x time matrices: one row a trial, its samples in ``signal`` (array<double>).

``by`` names the columns that tell matrices apart. Nothing gathers a matrix into one row but the last step of
``images``, whose images have a bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws, taps
from ..session import work_table
from .arrays import lists_of, matrix_of
from .facts import crowded, with_facts
from .moments import moments
from .selection import first_rows, quantile

PATTERNS = ("sigmoid", "one_sided_fan", "two_sided_fan", "diverging_bar", "hourglass", "tilted_bar", "no_class")
#: (variant, trial order, inverted)
VARIANTS = (("normal", "normal", False), ("reversed", "reversed", False), ("inverted", "normal", True), ("reversed_inverted", "reversed", True))


def pattern_keys(pattern: str, seed: int = 0) -> list[Column]:
    """Sort keys of a pattern over the trial table's columns; presentation order breaks ties."""
    keys = {
        "sigmoid": [F.col("dlatency"), F.col("latency")],
        "one_sided_fan": [F.col("one_sided_fan_duration")],
        "two_sided_fan": [F.col("two_sided_fan_duration")],
        "diverging_bar": [F.col("diverging_bar_condition") == "car"],
        "hourglass": [F.col("hourglass_continuous")],
        "tilted_bar": [F.col("tilted_bar_duration")],
        "no_class": [draws.uniform(seed, "no_class", "rep", "trial")],
    }
    if pattern not in keys:
        raise ValueError(f"unknown pattern {pattern}; known: {', '.join(PATTERNS)}")
    return [*keys[pattern], F.col("trial")]


def ranked(df: DataFrame, keys: Sequence[Column | str], by: Sequence[str] = (), name: str = "y", spread: bool | None = None) -> DataFrame:
    """``name``: position from 1 within each matrix by the keys.

    Many small matrices are ranked by a window. With ``spread`` (unless told, where one is larger than a task should
    take; where ``by`` is empty, always) rows are sorted in ranges over all tasks and saved, and a row's rank is its place
    in its range after the rows of the ranges before.
    """
    by, keys = list(by), [F.col(k) if isinstance(k, str) else k for k in keys]
    if by and not (crowded(df, by) if spread is None else spread):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*keys)).cast("int"))
    order, ranges = [*map(F.col, by), *keys], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the id holds the range above bit 33 and the place in it below
    rows = work_table(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("_range", F.shiftright("_id", 33))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    before = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_range", "_before")
    if by:
        rows = with_facts(rows, rows.groupBy(*by).agg((F.min(name) - 1).alias("_ahead")), by).withColumn(name, F.col(name) - F.col("_ahead")).drop("_ahead")
    return rows.withColumn(name, F.col(name).cast("int"))


def guarded(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Raises an error where there is no trial, and where a trial has no samples or no value to sort by."""
    if df.isEmpty():
        raise ValueError("there are no trials")
    fail = lambda message: F.raise_error(F.lit(message)).cast("array<double>")
    signal = F.when(F.coalesce(F.size("signal"), F.lit(0)) <= 0, fail("a trial has no samples"))
    for k in keys:
        signal = signal.when(F.col(k).isNull(), fail(f"a trial has no value of {k} to sort by"))
    return df.withColumn("signal", signal.otherwise(F.col("signal")))


def sort_key(seed: int = 0) -> Column:
    """One comparable key for every pattern, so that seven orders take one window."""
    number = lambda c: F.struct(c.cast("double").alias("a"), F.lit(0.0).alias("b"), F.col("trial").alias("c"))
    out = F.struct(F.col("dlatency").cast("double").alias("a"), F.col("latency").cast("double").alias("b"), F.col("trial").alias("c"))
    cases = {
        "one_sided_fan": F.col("one_sided_fan_duration"), "two_sided_fan": F.col("two_sided_fan_duration"), "hourglass": F.col("hourglass_continuous"),
        "tilted_bar": F.col("tilted_bar_duration"), "diverging_bar": (F.col("diverging_bar_condition") == "car").cast("int"), "no_class": draws.uniform(seed, "no_class", "rep", "trial"),
    }
    for pattern, value in cases.items():
        out = F.when(F.col("pattern") == pattern, number(value)).otherwise(out)
    return out


def drop_count(rate: Column, n: Column) -> Column:
    """``rate`` is a number of trials; at least one trial stays."""
    return draws.clamp(F.rint(rate).cast("long"), F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)).cast("long"))


def dropout(df: DataFrame, rate: Column, seed: int, by: Sequence[str] = (), key: Sequence[str] = ("trial",), spread: bool | None = None) -> DataFrame:
    """Without ``drop_count(rate, n)`` trials of each matrix, chosen by hash; ``dropped`` tells how many.

    With ``spread`` (see ``ranked``) the hash below which trials go is selected by counts, and a filter drops them.
    Otherwise a window ranks each matrix.
    """
    by, u = list(by), draws.uniform(seed, "drop", *by, *key)
    if by and not (crowded(df, by) if spread is None else spread):
        group = Window.partitionBy(*by)
        df = df.withColumn("_n", F.count("*").over(group)).withColumn("_place", F.row_number().over(group.orderBy(u, *key)))
        df = df.withColumn("dropped", drop_count(rate, F.col("_n")))
        return df.where(F.col("_place") > F.col("dropped")).drop("_place", "_n")
    counts = df.groupBy(*by).agg(drop_count(F.max(rate), F.count("*")).alias("count"))
    ends = work_table(first_rows(df, u, key, counts, by), "limits")
    facts = with_facts(counts.withColumnRenamed("count", "dropped"), ends.drop("count"), by, "left")
    known, last = with_facts(df.withColumn("_u", u), facts, by), F.struct(*key)
    after = F.col("limit").isNull() | (F.col("_u") > F.col("limit")) | ((F.col("_u") == F.col("limit")) & (last > F.col("last")))
    left = known.where(after)
    if not ends.where("spare < same").isEmpty():  # rows of one key: some of them stay
        tied = known.where((F.col("_u") == F.col("limit")) & (last == F.col("last"))).withColumn("_at", F.monotonically_increasing_id())
        left = left.unionByName(ranked(tied, ["_at"], by, "_place", True).where("_place > spare").drop("_at", "_place"))
    return left.drop("_u", "limit", "last", "same", "spare")


def crop_samples(n: Column, start_ms: Column, end_ms: Column, rate: Column) -> tuple[Column, Column]:
    """Samples cut at either end: clamped, so that one is left."""
    cut = lambda ms: F.rint(F.rint(F.greatest(ms, F.lit(0.0))) * rate / 1000.0).cast("int")
    start = draws.clamp(cut(start_ms), F.lit(0), n - 1)
    end = draws.clamp(cut(end_ms), F.lit(0), n - 1 - start)
    return F.when(n <= 1, F.lit(0)).otherwise(start), F.when(n <= 1, F.lit(0)).otherwise(end)


def cropped(signal: Column, start: Column, end: Column) -> Column:
    return F.slice(signal, start + 1, F.size(signal) - start - end)


def zscored(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``signal`` standardised at each time point over the trials; null where the deviation is 0 or undefined."""
    stats = moments(df, "signal", by).select(*by, F.arrays_zip("mean", "deviation").alias("_stats"))
    z = F.zip_with("signal", "_stats", lambda v, x: F.try_divide(v - x["mean"], x["deviation"]))
    return with_facts(df, stats, by).withColumn("signal", z).drop("_stats")


#: What the weights of an axis depend on: its length, whether it is smoothed, whether it is low-passed.
AXIS = ("_n", "_smooth", "_low")
#: Outputs whose weights are made at once, as each may have many inputs.
OUTPUTS = 200


def axis_weights(axes: DataFrame, size: int, method: str = "linear", sigma: float = 0.0, length: int = 0, antialias: float = 0.0, filtered: bool = False) -> DataFrame:
    """(``AXIS``, o, i, w) for each distinct axis: made once, on the executors, where a long axis has many tasks."""

    def run(batches):
        for b in batches:
            for (n, smooth, low), g in b.groupby(list(AXIS)):
                outputs = g["o"].to_numpy()
                for s in range(0, len(outputs), OUTPUTS):
                    o, i, w = taps.axis(int(n), size, method, sigma if smooth else 0.0, length, antialias if low else 0.0, outputs[s : s + OUTPUTS], filtered)
                    yield pd.DataFrame({"_n": n, "_smooth": smooth, "_low": low, "o": o, "i": i, "w": w})

    axes = axes.select(F.col("_n").cast("int").alias("_n"), "_smooth", "_low").where(F.col("_n") > 0).distinct()
    outputs = axes.withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(size) if size > 0 and not filtered else F.col("_n")))).repartition("_n", "o")
    return outputs.mapInPandas(run, "_n int, _smooth boolean, _low boolean, o int, i int, w double")


def with_axis(df: DataFrame, n: Column, size: int, smooth: Column | None, low: Column | None) -> DataFrame:
    """``AXIS`` of each row; an axis by itself is low-passed if its own length changes."""
    smooth = n > 1 if smooth is None else smooth
    low = (n > 1) & F.lit(size > 0) & (n != size) if low is None else low
    return df.withColumns({"_n": n.cast("int"), "_smooth": smooth, "_low": low})


def time_axis(df: DataFrame, size: int, method: str = "linear", smooth: Column | None = None, low: Column | None = None, **filters) -> DataFrame:
    """``signal`` filtered and resized along time; each row keeps its wide form.

    A spline's coefficients come from recurrences over each signal, after the filters.
    """
    if size <= 0 and not filters.get("sigma"):
        return df
    spline = size > 0 and method in taps.SPLINES
    if not spline or any(filters.values()):
        df = with_axis(df, F.size("signal"), size, smooth, low)
        w = axis_weights(df, size, method, **filters, filtered=spline)
        w = w.groupBy(*AXIS, "o").agg(F.collect_list(F.struct("i", "w")).alias("taps"))
        w = w.groupBy(*AXIS).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "taps"))), lambda x: x["taps"]).alias("_taps"))
        value = lambda each: F.aggregate(each, F.lit(0.0), lambda a, x: a + x["w"] * F.element_at("signal", x["i"]))
        df = df.join(w, list(AXIS)).withColumn("signal", F.transform("_taps", value)).drop(*AXIS, "_taps")
    return df.mapInArrow(_splines(size, taps.SPLINES[method]), df.schema) if spline else df


def _splines(size: int, degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("signal")
            a, valid, length = matrix_of(b.column(at))
            rows: list[np.ndarray] = [np.zeros(0)] * len(length)
            for n in np.unique(length[length > 0]).tolist():
                which = np.flatnonzero(length == n)
                resized_rows = taps.spline_samples(a[which, :n], size, degree) if n != size else a[which, :n]
                for k, row in zip(which.tolist(), resized_rows):
                    rows[k] = row
            gaps = [np.full(len(row), not v[:n].all()) for row, v, n in zip(rows, valid, length)]  # a null leaves no value of its signal
            yield b.set_column(at, b.schema.field(at), lists_of(rows, gaps, b.schema.field(at).type))

    return run


#: Outputs and inputs along the trial axis that a task combines at a time.
BLOCK_OUTPUTS, BLOCK_INPUTS = 256, 1024


def trial_axis(df: DataFrame, size: int, by: Sequence[str] = (), method: str = "linear", n: Column | None = None, smooth: Column | None = None, low: Column | None = None, **filters) -> DataFrame:
    """Long rows (by, y, x, v): rows ranked by ``y`` combined to ``size`` rows of each matrix; ``n`` is its number of rows.

    A stencil: outputs are cut into blocks, and a row is sent to each block within the reach of its kernel, so that
    it meets the ghost rows of the blocks beside it; of large kernels, a block's inputs are several parts, whose sums are added
    up at last. Rows stay arrays, and their number grows by the ghost rows alone, whatever the kernel's length.
    """
    by = list(by)
    if n is None:
        df, n = with_sizes(df, by), F.col("_height")
    if size <= 0 and not filters.get("sigma"):
        return df.select(*by, F.col("y").cast("int").alias("y"), F.posexplode("signal").alias("x", "v")).withColumn("x", F.col("x") + 1)
    df = with_axis(df, n, size, smooth, low).select(*by, F.col("y").cast("long").alias("y"), "signal", *AXIS)
    reach, outputs = _reach(size, method, **filters), F.lit(size).cast("long") if size > 0 else F.col("_n").cast("long")
    scale = outputs / F.col("_n")
    first, last = [draws.clamp((F.floor((F.col("y") + side * reach - 0.5) * scale + 0.5) + 2 * side).cast("long"), F.lit(1).cast("long"), outputs) for side in (-1, 1)]
    block = lambda o: F.floor((o - 1) / BLOCK_OUTPUTS)
    sent = df.withColumn("_block", F.explode(F.sequence(block(first), block(last))))
    start = F.greatest(F.floor((F.col("_block") * BLOCK_OUTPUTS + 0.5) / scale + 0.5) - reach - 1, F.lit(1))
    sent = sent.withColumn("_part", F.floor((F.col("y") - start) / BLOCK_INPUTS))
    kinds = df.select(*by).schema.fields
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], "y int", "signal array<double>"])
    sums = sent.groupBy(*by, *AXIS, "_block", "_part").applyInArrow(_combined(size, by, method, **filters), schema)
    cells = sums.select(*by, "y", F.posexplode("signal").alias("x", "v"))
    return cells.groupBy(*by, "y", (F.col("x") + 1).alias("x")).agg(F.sum("v").alias("v"))


def _reach(size: int, method: str, sigma: float = 0.0, length: int = 0, antialias: float = 0.0) -> Column:
    """Inputs on either side that an output's value depends on."""
    own = 0 if size <= 0 else taps.SPAN.get(method, taps.REACH + 2)
    smooth = F.when(F.col("_smooth"), (length + 1) // 2).otherwise(0) if sigma > 0 else F.lit(0)
    low = F.when(F.col("_low"), 2 * F.ceil(antialias * F.col("_n") / size)).otherwise(0) if antialias > 0 and size > 0 else F.lit(0)
    return (smooth + low + own + 1).cast("long")


def _combined(size: int, by: list[str], method: str, sigma: float = 0.0, length: int = 0, antialias: float = 0.0):
    def run(table: pa.Table) -> pa.Table:
        head = table.slice(0, 1).to_pylist()[0]
        n, smooth, low, block = (head[c] for c in (*AXIS, "_block"))
        y = table.column("y").to_numpy()
        outputs = np.arange(block * BLOCK_OUTPUTS + 1, min((block + 1) * BLOCK_OUTPUTS, size if size > 0 else n) + 1)
        k = taps.kernel(n, size, sigma if smooth else 0.0, length, antialias if low else 0.0)
        w = taps.stencil(n, size, method, k, outputs, y)
        a, valid, _ = matrix_of(table.column("signal").combine_chunks())
        finite, used = valid & np.isfinite(a), (w != 0).astype(float)
        values, none = w @ np.where(finite, a, 0.0), np.zeros((len(w), a.shape[1]), bool)
        if not finite.all():  # nulls add nothing; where there is nothing else, the sum is null
            values[used @ (valid & ~finite) > 0] = np.nan
            none = used @ valid == 0
        some = np.flatnonzero(used.any(1))
        keys = [pa.array([head[c]] * len(some), table.schema.field(c).type) for c in by]
        return pa.Table.from_arrays([*keys, pa.array(outputs[some].astype(np.int32)), lists_of(list(values[some]), list(none[some]), pa.list_(pa.float64()))], names=[*by, "y", "signal"])

    return run


def with_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``_height``, ``_width`` of each row's matrix; an error where it is empty or its rows differ in length."""
    facts = [F.count("*").alias("_height"), F.min(F.coalesce(F.size("signal"), F.lit(0))).alias("_width"), F.max(F.size("signal")).alias("_longest")]
    if by:
        df = with_facts(df, df.groupBy(*by).agg(*facts), by)
        bad = (F.col("_width") <= 0) | (F.col("_width") != F.col("_longest"))
        message = F.lit("a matrix is empty or its trials differ in length")
        return df.withColumn("_width", F.when(bad, F.raise_error(message).cast("int")).otherwise(F.col("_width"))).drop("_longest")
    height, width, longest = df.agg(*facts).first()
    if not height or width <= 0 or width != longest:
        raise ValueError("the matrix is empty or its trials differ in length")
    return df.withColumns({"_height": F.lit(height), "_width": F.lit(width)})


def resized(df: DataFrame, height: int, width: int, by: Sequence[str] = (), method: str = "linear", **filters) -> DataFrame:
    """Long cells (by, y, x, v) of each matrix smoothed, low-passed and resized along both axes.

    A matrix with one row or one column is not filtered. If its size changes along either axis, both are low-passed.
    Without a positive height and width nothing is resized. Sizes are counted here unless ``with_sizes`` has told them
    before costlier steps.
    """
    if height <= 0 or width <= 0:
        height = width = 0
    df = df if "_height" in df.columns else with_sizes(df, by)
    h, w = F.col("_height"), F.col("_width")
    smooth = F.least(h.cast("long"), w.cast("long")) > 1
    df = df.withColumns({"_filtered": smooth, "_changed": smooth & F.lit(height > 0) & ((h != height) | (w != width))})
    smooth, low = F.col("_filtered"), F.col("_changed")
    return trial_axis(time_axis(df, width, method, smooth, low, **filters), height, by, method, h, smooth, low, **filters)


def images(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, image array<array<float>>) of long cells; an image is of bounded size."""
    rows = cells.groupBy(*by, "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda c: c["v"].cast("float")).alias("row"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda r: r["row"]).alias("image"))


def variants(df: DataFrame) -> DataFrame:
    """Four rows for each image: as it is, trials reversed, negated, both."""
    specs = F.array(*[F.struct(F.lit(k + 1).alias("vidx"), F.lit(v).alias("variant"), F.lit(o).alias("trial_order"), F.lit(i).alias("inverted")) for k, (v, o, i) in enumerate(VARIANTS)])
    df = df.withColumn("_v", F.explode(specs)).select("*", "_v.*").drop("_v")
    turned = F.when(F.col("trial_order") == "reversed", F.reverse("image")).otherwise(F.col("image"))
    return df.withColumn("image", F.when(F.col("inverted"), F.transform(turned, lambda r: F.transform(r, lambda v: -v))).otherwise(turned))


def color_range(cells: DataFrame, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """(by, range): the symmetric display range, the 0.99 quantile of absolute values, at least the least float step."""
    q = quantile(cells.withColumn("_size", F.abs(value)), "_size", 0.99, by)
    return q.select(*by, F.greatest("quantile", F.lit(math.ldexp(1, -23))).alias("range"))
