"""Operators whose groups may be larger than a task, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavegrid.functions import taps
from wavegrid.operators import events, facts, grid, matrix, moments, selection


@pytest.mark.parametrize("few", [1, 5, 1000])
def test_order_statistics(spark, few):
    r = random.Random(few)
    values = {"a": [r.gauss(0, 1) for _ in range(500)], "b": [1.0] * 300 + [2.0] * 5 + [-math.inf], None: [float(r.randrange(4)) for _ in range(200)], "c": [7.0], "d": [math.nan, 1.0, math.inf]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "g string, v double").repartition(5)
    for share in (0.0, 0.3, 0.985, 1.0):
        places = df.groupBy("g").agg(F.floor((F.count("v") - 1) * share).alias("place"))
        got = {x["g"]: x["kth"] for x in selection.order_statistic(df, "v", places, ["g"], few).collect()}
        want = {g: sorted(vs, key=lambda v: (math.isnan(v), v))[int((len(vs) - 1) * share)] for g, vs in values.items()}
        assert {g: str(v) for g, v in got.items()} == {g: str(v) for g, v in want.items()}


@pytest.mark.parametrize("few", [2, 1000])
def test_quantiles(spark, few):
    r = np.random.default_rng(2)
    groups = {"one": r.lognormal(0, 4, 3000), "ties": r.integers(0, 3, 900).astype(float), "single": np.array([4.0]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(7)
    for q in (0.0, 0.5, 0.99, 1.0):
        got = {x["g"]: x["quantile"] for x in selection.quantile(df, "v", q, ["g"], few).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            assert got[g] == pytest.approx(np.quantile(vs, q), rel=1e-12)
    alone = selection.quantile(df.where("g = 'one'"), "v", 0.99, few=few).collect()  # one group over all tasks
    assert [x["quantile"] for x in alone] == pytest.approx([np.quantile(groups["one"], 0.99)], rel=1e-12)
    assert selection.quantile(df.limit(0), "v", 0.5).collect() == []
    assert selection.quantile(df.limit(0), "v", 0.5, ["g"]).collect() == []


def test_quantile_keeps_no_group_in_a_buffer(spark):
    df = spark.range(50_000).withColumn("v", F.xxhash64("id") / F.lit(1e10))
    plan = selection.quantile(df, "v", 0.99)._jdf.queryExecution().toString().lower()
    assert "percentile(" not in plan and "rangepartitioning" not in plan
    values = np.array([x["v"] for x in df.select("v").collect()])
    assert selection.quantile(df, "v", 0.99).first()["quantile"] == pytest.approx(np.quantile(values, 0.99), rel=1e-12)


def test_dropout_drops_what_the_window_drops(spark):
    rows = [(g, t) for g in ("x", None, "y") for t in range(57)] + [("dup", 3)] * 40 + [("z", 1)]
    df = spark.createDataFrame(rows, "g string, trial long").repartition(6)
    kept = lambda d: sorted(map(str, d.collect()))
    assert kept(matrix.dropout(df, F.lit(17.0), 5, ["g"], spread=True)) == kept(matrix.dropout(df, F.lit(17.0), 5, ["g"]))
    whole = matrix.dropout(df.where("g = 'x'"), F.lit(17.0), 5).collect()
    assert len(whole) == 40 and {r["dropped"] for r in whole} == {17}
    assert len(matrix.dropout(df, F.lit(-2.0), 5, ["g"], spread=True).collect()) == len(rows)
    plan = matrix.dropout(df.where("g = 'x'"), F.lit(17.0), 5)._jdf.queryExecution().toString().lower()
    assert "rangepartitioning" not in plan and "sort [" not in plan


def test_moments_far_from_zero(spark):
    r = np.random.default_rng(4)
    a = r.normal(1e9, 1e-3, (3000, 4))
    df = spark.createDataFrame([(k % 3, row) for k, row in enumerate(a.tolist())], "g int, signal array<double>").repartition(9)
    for x in moments.moments(df, "signal", ["g"]).collect():
        mine = a[np.arange(len(a)) % 3 == x["g"]]
        assert x["n"] == [1000] * 4 and np.allclose(np.array(x["mean"]) - 1e9, (mine - 1e9).mean(0), atol=1e-6) and np.allclose(x["deviation"], mine.std(0, ddof=1), rtol=1e-4)


def test_moments_of_ragged_rows(spark):
    rows = [("a", [1.0, None, 3.0]), ("a", [2.0]), ("a", None), ("a", []), (None, [5.0, 6.0]), ("a", [4.0, 9.0])]
    df = spark.createDataFrame(rows, "g string, signal array<double>").repartition(3)
    got = {x["g"]: (x["n"], x["mean"], x["deviation"]) for x in moments.moments(df, "signal", ["g"]).collect()}
    n, mean, deviation = got["a"]
    assert (n, mean[1:], deviation[1:]) == ([3, 1, 1], [9.0, 3.0], [None, None]) and mean[0] == pytest.approx(7 / 3) and deviation[0] == pytest.approx(np.std([1, 2, 4], ddof=1))
    assert got[None] == ([1, 1], [5.0, 6.0], [None, None])
    assert moments.moments(df.limit(0), "signal").collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_moments_merge(seed):
    r = np.random.default_rng(seed)
    a, valid = r.normal(3, 2, (40, 5)), r.random((40, 5)) < 0.8
    whole = moments.state_of(a, valid)
    parts = [moments.state_of(a[s : s + 7], valid[s : s + 7]) for s in range(0, 40, 7)]
    state = parts[0]
    for p in parts[1:]:
        state = moments.merged(state, p)
    assert all(np.allclose(x, y) for x, y in zip(state, whole))


def dense_spline(values, size, degree):
    """Coefficients from one dense system, for each output its weights by hand."""
    n = len(values)
    if n == 1:
        return np.repeat(values, size, 0)
    system, right = np.zeros((n + 2, n + 2)), np.zeros(n + 2)
    for k in range(n):
        system[k + 1, k : k + 3] = (1 / 8, 6 / 8, 1 / 8) if degree == 2 else (1 / 6, 4 / 6, 1 / 6)
        right[k + 1] = values[k]
    system[0, :3] = system[-1, -3:] = 1, -2, 1
    c = np.linalg.solve(system, right)
    out = []
    for o in range(1, size + 1):
        p = min(max((o - 0.5) * n / size + 0.5, 1), n)
        out.append(sum(c[k] * taps._spline(np.array(p - k), degree) for k in range(n + 2)))
    return np.array(out)


@pytest.mark.parametrize("degree, name", [(2, "quadratic_line_ongrid"), (3, "cubic_line_ongrid")])
@pytest.mark.parametrize("n, size", [(1, 3), (2, 5), (3, 4), (10, 7), (150, 31), (40, 90)])
def test_splines(degree, name, n, size):
    v = np.random.default_rng(n).normal(size=n)
    want = dense_spline(v, size, degree)
    assert np.allclose(taps.spline_samples(v[None, :], size, degree)[0], want, atol=1e-12)
    o, i, w = (np.array(x) for x in zip(*taps.resize(n, size, name)))
    assert np.allclose(np.bincount(o - 1, w * v[i - 1], size), want, atol=1e-12)


@pytest.mark.parametrize("degree", [2, 3])
def test_tridiagonal(degree):
    side, middle = {2: (1 / 8, 3 / 4), 3: (1 / 6, 2 / 3)}[degree]
    right = np.random.default_rng(1).normal(size=(9, 3))
    system = np.diag([middle] * 9) + np.diag([side] * 8, 1) + np.diag([side] * 8, -1)
    assert np.allclose(system @ taps.tridiagonal(right, degree), right)


@pytest.mark.parametrize("n, size, method, sigma, length, antialias", [(30, 0, "linear", 1.0, 20, 0.0), (7, 0, "linear", 2.0, 31, 0.0), (200, 9, "linear", 0.0, 0, 0.75), (200, 9, "cubic_line_ongrid", 1.0, 5, 0.75), (50, 120, "lanczos4_opencv", 1.0, 5, 0.75), (1, 4, "linear", 1.0, 5, 0.75), (2, 1, "nearest", 1.0, 9, 0.75)])
def test_stencil_of_parts(n, size, method, sigma, length, antialias):
    """Weights of parts of the outputs and inputs are those of the whole."""
    k = taps.kernel(n, size, sigma, length, antialias)
    count = size or n
    whole = np.zeros((count, n))
    if n > 1:
        o, i, w = taps.axis(n, size, method, sigma, length, antialias)
        np.add.at(whole, (o - 1, i - 1), w)
    else:
        whole[:] = 1
    inputs = np.arange(1, n + 1)
    for outputs in np.array_split(np.arange(1, count + 1), 4):
        for part in np.array_split(inputs, 3):
            if len(outputs) and len(part):
                assert np.allclose(taps.stencil(n, size, method, k, outputs, part), whole[outputs - 1][:, part - 1], atol=1e-12)


@pytest.mark.parametrize("blocks, height, method", [((3, 4), 0, "linear"), ((1, 1), 6, "linear"), ((5, 100), 70, "cubic_line_ongrid"), ((4, 7), 6, "quadratic_line_ongrid")])
def test_trial_axis_in_blocks(spark, monkeypatch, blocks, height, method):
    monkeypatch.setattr(matrix, "BLOCK_OUTPUTS", blocks[0])
    monkeypatch.setattr(matrix, "BLOCK_INPUTS", blocks[1])
    a = np.random.default_rng(6).normal(size=(33, 3))
    rows = [(m, k + 1, (f * row).tolist()) for m, f in (("a", 1), (None, 2)) for k, row in enumerate(a)]
    df = spark.createDataFrame(rows, "m string, y int, signal array<double>").repartition(3)
    filters = {"sigma": 1.0, "length": 7, "antialias": 0.75}
    weights = np.zeros((height or 33, 33))
    o, i, w = taps.axis(33, height, method, **filters)
    np.add.at(weights, (o - 1, i - 1), w)
    got = {m: np.full((height or 33, 3), np.nan) for m in ("a", None)}
    for r in matrix.trial_axis(df, height, ["m"], method, **filters).collect():
        got[r["m"]][r["y"] - 1, r["x"] - 1] = r["v"]
    assert np.allclose(got["a"], weights @ a) and np.allclose(got[None], 2 * weights @ a)


def test_nulls_and_not_numbers_stay_in_reach(spark):
    rows = [(k, [1.0, None, 1.0]) for k in range(1, 41)]
    rows[4] = (5, [math.nan, None, 1.0])
    df = spark.createDataFrame(rows, "y int, signal array<double>")
    got = {(r["y"], r["x"]): r["v"] for r in matrix.trial_axis(df, 0, sigma=1.0, length=5).collect()}
    assert all(math.isnan(got[y, 1]) == (3 <= y <= 7) for y in range(1, 41))
    assert {got[y, 2] for y in range(1, 41)} == {None} and got[9, 3] == pytest.approx(1)


def test_rows_sent_grow_with_the_cells_alone(spark):
    """A long kernel makes no row for each trial and tap."""
    df = spark.range(1, 3001).select(F.col("id").cast("int").alias("y"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("signal"))
    out = matrix.trial_axis(df, 4, antialias=0.75)
    cells = {(r["y"], r["x"]): r["v"] for r in out.collect()}
    assert len(cells) == 8 and cells[2, 2] == pytest.approx(1) and cells[1, 1] < cells[4, 1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInPandas" not in plan


def test_running_sums_over_all_tasks(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", None, "b"]), k, r.choice([None, -3, 0, 5, 1 << 33]), "x") for k in range(700)] + [(f"s{k}", 1, k, "x") for k in range(30)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "g string, k int, gap long, latency string").repartition(5)
    for by in (["g"], []):
        got = {(x["g"], x["k"]): x["latency"] for x in events.onsets(df, by, ["k", "g"], F.col("gap"), spread=True).collect()}
        total, want = {}, {}
        for g, k, gap, _ in sorted(rows, key=lambda x: (x[1], x[0] is not None, x[0] or "")):
            run = g if by else 0
            total[run] = total.get(run, 0) + (gap or 0)
            want[g, k] = total[run]
        assert got == want
    small = events.onsets(df, ["g"], ["k"], F.col("gap"))
    assert {(x["g"], x["k"]): x["latency"] for x in small.collect()} == {(x["g"], x["k"]): x["latency"] for x in events.onsets(df, ["g"], ["k"], F.col("gap"), spread=True).collect()}
    assert events.onsets(df.limit(0), [], ["k"], F.col("gap")).collect() == []


def test_differences_over_all_tasks(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "a", None, "b"]), k, r.choice([None, -3, 0, 5, 1 << 33]), "x") for k in range(700)] + [(f"s{k}", 1, k, "x") for k in range(30)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "g string, k int, latency long, dlatency string").repartition(5)
    shown = lambda d: sorted(map(str, d.collect()))
    assert shown(events.delta_latency(df, ["g"], ["k"], spread=True)) == shown(events.delta_latency(df, ["g"], ["k"], spread=False))
    one = df.withColumn("one", F.lit(1))
    assert shown(events.delta_latency(df, [], ["k", "g"])) == shown(events.delta_latency(one, ["one"], ["k", "g"], spread=False).drop("one"))
    assert events.delta_latency(df.limit(0), [], ["k"]).collect() == []


def test_a_large_group_is_spread(spark, monkeypatch):
    df = spark.createDataFrame([("a", k, 2 * k) for k in range(50)] + [("b", 1, 1)], "g string, k int, latency long")
    assert not facts.crowded(df, ["g"]) and facts.crowded(df, [])
    plans = lambda: [d._jdf.queryExecution().toString() for d in (events.delta_latency(df, ["g"], ["k"]), matrix.ranked(df, ["k"], ["g"]), events.onsets(df, ["g"], ["k"], F.col("k")))]
    assert all("windowspecdefinition(g#" in p for p in plans())
    monkeypatch.setattr(facts, "GROUP_ROWS", 20)
    assert facts.crowded(df, ["g"]) and not any("windowspecdefinition(g#" in p for p in plans()[:2])


def test_grid(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 7, 4), (2, 3, 4)], "rep int, p int, v int")
    df = df.withColumn("idx", grid.output_index(F.col("rep"), F.col("p"), F.col("v")))
    assert [x["idx"] for x in df.orderBy("idx").collect()] == [1, 28, 40]
    assert all(tuple(x["at"]) == (x["rep"], x["p"], x["v"]) for x in df.withColumn("at", grid.grid_place(F.col("idx"))).collect())
    every = [tuple(x[0]) for x in spark.range(1, 85).select(grid.grid_place(F.col("id"))).collect()]
    assert len(set(every)) == 84 and {x[0] for x in every} == {1, 2, 3} and {x[1:] for x in every} == {(p, v) for p in range(1, 8) for v in range(1, 5)}


def test_cells_without_an_image_are_skipped(spark):
    images = spark.createDataFrame([(5, 1, 1), (3, 1, 1), (None, 1, 2), (9, 2, 1)], "idx int, p int, v int")
    cells = spark.createDataFrame([(p, v) for p in (1, 2) for v in (1, 2)], "p int, v int")
    assert sorted(map(tuple, grid.first_per_cell(images, ["p", "v"]).collect())) == [(1, 1, 3), (2, 1, 9)]
    assert [tuple(x) for x in grid.empty_cells(cells, images.where("idx IS NOT NULL"), ["p", "v"]).orderBy("p").collect()] == [(1, 2), (2, 2)]
