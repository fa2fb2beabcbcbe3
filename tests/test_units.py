"""Hand-computed values of the expressions, the weights and the settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavegrid.functions import draws, signals, taps
from wavegrid.operators import events, matrix, noise
from wavegrid.plans import config, simulate
from wavegrid.plans.diagnostics import Diagnostics, merged, totals


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_levels_and_windows(spark):
    up, down, three, single = one(spark, signals.levels(F.lit(20.0), F.lit(100.0), F.lit(5)), signals.levels(F.lit(20.0), F.lit(10.0), F.lit(3)), signals.hanning(F.lit(3)), signals.hanning(F.lit(1)))
    assert up == [20, 40, 60, 80, 100] and down == [20, 15, 10]
    assert three == pytest.approx([0, 1, 0]) and single == [1.0]


def test_bases(spark):
    tilted, short, fan = one(spark, signals.tilted_bar(F.lit(40), F.lit(101)), signals.tilted_bar(F.lit(40), F.lit(60)), signals.two_sided_fan(F.lit(13), F.lit(30), F.lit(40)))
    assert len(tilted) == 101 and not any(tilted[:40]) and not any(tilted[90:]) and len(short) == 60
    assert not any(fan[:8]) and fan[14] == pytest.approx(1.0)


@pytest.mark.parametrize(
    "n, start, end, rate, expected",
    [(101, 100, 100, 100, (10, 10)), (101, 25, 35, 100, (2, 4)), (10, 50, 50, 1000, (9, 0)), (1, 100, 100, 100, (0, 0))],
)
def test_crop(spark, n, start, end, rate, expected):
    got = one(spark, *matrix.crop_samples(F.lit(n), F.lit(float(start)), F.lit(float(end)), F.lit(float(rate))))
    assert tuple(got) == expected


@pytest.mark.parametrize("n, rate, expected", [(162, 2000, 161), (8192, 50, 50), (1, 5, 0), (10, -3.2, 0)])
def test_drop_count(spark, n, rate, expected):
    assert one(spark, matrix.drop_count(F.lit(float(rate)), F.lit(n)))[0] == expected


def test_delta_latency_and_sigmoid_order(spark):
    df = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate((10, 35, 50, 90))], "rep int, trial int, latency long")
    df = events.delta_latency(df, ["rep"], ["trial"])
    assert [r.dlatency for r in df.orderBy("trial").collect()] == [25, 15, 40, 0]
    order = matrix.ranked(df, matrix.pattern_keys("sigmoid"), ["rep"]).orderBy("y").collect()
    assert [r.trial for r in order] == [4, 2, 1, 3]


def test_diverging_bar_is_stable(spark):
    df = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate(("car", "face", "car", "face"))], "rep int, trial int, diverging_bar_condition string")
    assert [r.trial for r in matrix.ranked(df, matrix.pattern_keys("diverging_bar"), ["rep"]).orderBy("y").collect()] == [2, 4, 1, 3]


def test_large_matrices_are_ranked_over_all_tasks(spark):
    rows = [("a" if k % 3 else None, k * 7 % 5, k) for k in range(200)] + [("b", 1, 1), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "g string, key int, id int")
    plain = {(r.g, r.key, r.id, r.y) for r in matrix.ranked(df, ["key", "id"], ["g"]).collect()}
    assert {(r.g, r.key, r.id, r.y) for r in matrix.ranked(df, ["key", "id"], ["g"], spread=True).collect()} == plain
    got = sorted((r.y, r.key, r.id) for r in matrix.ranked(df, ["key", "id"]).collect())
    assert [g[1:] for g in got] == sorted((k, i) for _, k, i in rows) and [g[0] for g in got] == list(range(1, 203))
    kept = lambda **how: sorted((r.id, r.dropped) for r in matrix.dropout(df, F.lit(20.0), 3, ["g"], ["id"], **how).collect())
    assert kept() == kept(spread=True)
    assert matrix.dropout(df, F.lit(20.0), 3, key=["id"]).count() == 182
    assert matrix.ranked(df.limit(0), ["key"]).count() == 0


def test_delta_latency_of_one_run(spark):
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate((10, 35, 50, 90))], "trial int, latency long")
    assert [r.dlatency for r in events.delta_latency(df, [], ["trial"]).orderBy("trial").collect()] == [25, 15, 40, 0]


def plain_resized(a, height, width, sigma=0.0, length=0, antialias=0.0):
    """Smoothing, low-pass and linear resize of a whole matrix, by padding and interpolation."""

    def blurred(a, axis, s, length):
        half = length // 2
        k = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * s * s))
        pad = np.pad(a, [(half, half) if d == axis else (0, 0) for d in (0, 1)], mode="reflect")
        return np.apply_along_axis(np.convolve, axis, pad, k / k.sum(), "valid")

    change = height > 0 and width > 0 and a.shape != (height, width)
    if sigma and min(a.shape) > 1:
        a = blurred(blurred(a, 0, sigma, length), 1, sigma, length)
    if antialias and change and min(a.shape) > 1:
        for d, size in enumerate((height, width)):
            s = antialias * a.shape[d] / size
            a = blurred(a, d, s, 4 * int(np.ceil(s)) + 1)
    if change:
        for d, size in enumerate((height, width)):
            n = a.shape[d]
            at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
            a = np.apply_along_axis(lambda v: np.interp(at, np.arange(n), v), d, a)  # noqa: B023
    return a


@pytest.mark.parametrize(
    "shape, height, width, filters",
    [
        ((40, 12), 10, 12, {"antialias": 0.75}),  # one axis changes: both are low-passed
        ((40, 12), 40, 12, {"antialias": 0.75}),  # none changes: neither is
        ((1, 12), 1, 6, {"sigma": 1.0, "length": 5, "antialias": 0.75}),  # a single row is not filtered
        ((12, 1), 6, 1, {"sigma": 1.0, "length": 5}),
        ((9, 8), 0, 4, {"sigma": 1.0, "length": 5, "antialias": 0.75}),  # a size of 0: nothing is resized
        ((9, 30), 20, 10, {"sigma": 1.0, "length": 5, "antialias": 0.75}),
    ],
)
def test_both_axes_decide_together(spark, shape, height, width, filters):
    a = np.random.default_rng(5).normal(size=shape)
    df = spark.createDataFrame([("m", k + 1, row) for k, row in enumerate(a.tolist())], "m string, y int, signal array<double>")
    expected = plain_resized(a, height, width, **filters)
    for by in ([], ["m"]):
        got = np.full(expected.shape, np.nan)
        for r in matrix.resized(df, height, width, by, **filters).collect():
            got[r.y - 1, r.x - 1] = r.v
        assert np.allclose(got, expected, atol=1e-9)


def test_bad_matrices_raise(spark):
    schema = "m string, trial int, y int, key int, signal array<double>"
    empty, ragged = spark.createDataFrame([], schema), spark.createDataFrame([("m", 1, 1, 1, [1.0]), ("m", 2, 2, 2, [1.0, 2.0])], schema)
    for bad in (empty, ragged):
        with pytest.raises(ValueError):
            matrix.resized(bad, 2, 2)
    with pytest.raises(Exception, match="differ in length"):
        matrix.resized(ragged, 2, 2, ["m"]).collect()
    with pytest.raises(ValueError):
        matrix.guarded(empty)
    for row, message in ((("m", 1, 1, None, [1.0]), "sort by"), (("m", 1, 1, 1, []), "no samples"), (("m", 1, 1, 1, None), "no samples")):
        with pytest.raises(Exception, match=message):
            matrix.guarded(spark.createDataFrame([row], schema), ["key"]).collect()


def test_zscore(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [3.0, 5.0])], "trial int, signal array<double>")
    assert [r.signal for r in matrix.zscored(df).orderBy("trial").collect()] == [[-1.0, None], [0.0, None], [1.0, None]]


def test_variants(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "image array<array<float>>")
    got = {r.variant: r.image for r in matrix.variants(df).collect()}
    assert got == {"normal": [[1, 2], [3, 4]], "reversed": [[3, 4], [1, 2]], "inverted": [[-1, -2], [-3, -4]], "reversed_inverted": [[-3, -4], [-1, -2]]}


@pytest.mark.parametrize("method", taps.METHODS)
@pytest.mark.parametrize("n, size", [(64, 16), (10, 24), (500, 64), (7, 7), (3, 0)])
def test_resize_keeps_constants(method, n, size):
    total = {}
    for o, i, w in taps.resize(n, size, method):
        assert 1 <= i <= n
        total[o] = total.get(o, 0) + w
    assert sorted(total) == list(range(1, (size or n) + 1)) and np.allclose(list(total.values()), 1, atol=1e-9)


@pytest.mark.parametrize("method", ["linear", "quadratic_line_ongrid", "cubic_line_ongrid"])
def test_resize_keeps_straight_lines(method):
    out = np.zeros(16)
    for o, i, w in taps.resize(64, 16, method):
        out[o - 1] += w * i
    assert np.allclose(out, taps.positions(64, 16), atol=1e-8)


def test_linear_resize_and_kernels():
    out = np.zeros(2)
    for o, i, w in taps.resize(4, 2, "linear"):
        out[o - 1] += w * (i - 1)
    assert out.tolist() == [0.5, 2.5]
    assert len(taps.gauss(1, 20)) == len(taps.gauss(1, 21)) == 21
    assert taps.reflected(np.array([0, -1, 6]), 5).tolist() == [2, 3, 4]


def test_unknown_names_and_bad_settings():
    for bad in (dict(condition_levels=config.Dist("uniform", 1, 3)), dict(epoch_duration_s=config.N(0, 1)), dict(resize_method="no"), dict(noise_pool=(config.Noise("PinkNoise", None),))):
        with pytest.raises(ValueError):
            config.Config(**bad).checked()
    with pytest.raises(ValueError):
        matrix.pattern_keys("no")


def test_noise_is_reproducible_and_scaled(spark):
    for name in config.NOISES:
        x = [noise.realisation(name, np.random.default_rng(k), 256) for k in range(40)]
        assert 0.5 < np.std(x) < 1.5
    f = noise.noise("PinkNoise", 3)
    df = spark.range(1, 9).select(f(F.lit(1), F.col("id"), F.lit(16)).alias("x"), "id")
    assert sorted(map(str, df.repartition(1).collect())) == sorted(map(str, df.repartition(5).collect()))


def test_draws_have_the_right_moments(spark):
    x = spark.range(20000).select(draws.normal(5, "s", "id", mean=3.0, sd=2.0).alias("x"), draws.discrete_uniform(5, "u", "id", low=3, high=10).alias("k"))
    m, s, lo, hi = x.agg(F.avg("x"), F.stddev("x"), F.min("k"), F.max("k")).first()
    assert abs(m - 3) < 0.08 and abs(s - 2) < 0.08 and (lo, hi) == (3, 10)


def test_epochs_overlap_and_silence(spark):
    df = spark.createDataFrame([(1, 1, 0, [1.0, 2.0]), (1, 2, 1, [10.0, 20.0]), (1, 3, 1022, [5.0, 5.0])], "rep int, trial int, latency long, response array<double>")
    got = {r.trial: r.signal for r in events.epochs(df, ["rep"], F.lit(4)).collect()}
    assert got == {1: [1, 12, 20, 0], 2: [12, 20, 0, 0], 3: [5, 5, 0, 0]}


def test_diagnostics(spark):
    d = Diagnostics(enabled=True)
    with pytest.raises(RuntimeError), d.call("a"):
        raise RuntimeError
    assert d.snapshot()["counts"] == {"a": 1} and d.lines()[0].startswith("a: 1 calls")
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 1.0), ("a", 3, 0.25)], "name string, count long, time double")
    assert {r.name: (r["count"], r.time) for r in merged(df).collect()} == {"a": (4, 0.75), "b": (2, 1.0)}


def test_totals_by_worker(spark):
    df = spark.createDataFrame([("w", "a", 1, 0.5), (None, "a", 2, 1.0), ("w", "a", 3, 0.25)], "worker string, name string, count long, time double")
    assert {tuple(r) for r in totals(df).collect()} == {("w", "a", 4, 0.75, False), (None, "a", 2, 1.0, False), (None, "a", 6, 1.75, True)}


def test_public_names():
    import wavegrid

    assert all(getattr(wavegrid, n) is not None for n in wavegrid.__all__)
    with pytest.raises(AttributeError):
        wavegrid.missing


def test_dataset_round_trip(spark, tmp_path):
    from wavegrid.sources.dataset import load_dataset, save_dataset

    images = simulate.generate_erp_images(spark, config.TINY)
    path = save_dataset(images, str(tmp_path), "tiny", config.TINY, {"note": "x"})
    back, settings, environment = load_dataset(spark, path)
    rows = back.collect()
    assert sorted(r.idx for r in rows) == list(range(1, 29)) and settings["seed"] == 1 and environment["note"] == "x"
    assert set(simulate.METADATA) <= set(back.columns)
    by = {(r.pattern, r.variant): r for r in rows}
    n, i = by["hourglass", "normal"], by["hourglass", "inverted"]
    assert n.dropout_trials == 12 and n.erpimage_raw_size.h == 162 and n.erpimage_processed_size.h == 150
    assert i.image == [[-v for v in row] for row in n.image]
