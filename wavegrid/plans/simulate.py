"""The generator: run parameters, trial design, overlapping epochs, images with their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws, signals
from ..operators import events, matrix, noise
from ..operators.grid import output_index
from ..session import work_table
from .config import Config, Dist

GEOMETRY = ("p100", "p300", "n170")
METADATA = (
    "pattern", "variant", "trial_order", "inverted", "mu", "sigma", "epoch_duration_s", "sampling_rate", "crop_start_ms", "crop_end_ms", "crop_start_samples",
    "crop_end_samples", "dropout_trials_rate", "dropout_trials", "erpimage_raw_size", "erpimage_processed_size", "condition_levels", "noise", "noiselevels",
    "p1_beta", "p3_beta", "n1_betas", "p100_width", "p100_offset", "p300_width", "p300_offset", "n170_width", "n170_offset",
)


def draw(dist: Dist, seed: int, stream: str, *keys: str) -> Column:
    if dist.kind == "uniform":
        return draws.discrete_uniform(seed, stream, *keys, low=int(dist.a), high=int(dist.b)).cast("double")
    return draws.normal(seed, stream, *keys, mean=float(dist.a), sd=float(dist.b))


def sample_params(runs: DataFrame, cfg: Config) -> DataFrame:
    """One row for each rep with every draw, clamped; an epoch of no length raises an error."""
    d = lambda name: draw(getattr(cfg, name), cfg.seed, name, "rep")
    df = runs.select(
        "rep",
        F.greatest(F.lit(1.0), d("mu")).alias("mu"),
        F.greatest(F.lit(0.01), d("sigma")).alias("sigma"),
        F.greatest(F.lit(1), F.rint(d("condition_levels")).cast("int")).alias("condition_levels"),
        F.greatest(F.lit(1), F.rint(d("sampling_rate")).cast("int")).alias("sampling_rate"),
        d("epoch_duration_s").alias("epoch_duration_s"),
        F.greatest(F.lit(0), F.rint(d("dropout_trials_rate")).cast("int")).alias("dropout_trials_rate"),
        F.rint(F.greatest(F.lit(0.0), d("crop_start"))).cast("int").alias("crop_start_ms"),
        F.rint(F.greatest(F.lit(0.0), d("crop_end"))).cast("int").alias("crop_end_ms"),
        *[d(n).alias(n) for n in ("p1_beta", "p3_beta", "n1_beta1", "n1_beta2", "n1_beta3", "amp_a", "amp_b", "amp_c")],
        *[d(f"{n}_{e}").alias(f"{n}_{e}") for n in ("one_sided_fan", "two_sided_fan", "tilted_bar", "hourglass") for e in ("start", "end")],
        *[d(f"{g}_{x}").alias(f"{g}_{x}") for g in GEOMETRY for x in ("width", "offset")],
        F.array(*[F.greatest(F.lit(0.0), draw(n.level, cfg.seed, f"noise-{n.name}", "rep")) for n in cfg.noise_pool]).alias("levels") if cfg.noise_pool else F.array().cast("array<double>").alias("levels"),
    )
    bad = F.raise_error(F.lit("epoch_duration_s must be > 0")).cast("double")
    df = df.withColumn("epoch_duration_s", F.when(F.col("epoch_duration_s") > 0, F.col("epoch_duration_s")).otherwise(bad))
    df = df.withColumn("signal_len", F.greatest(F.lit(2), F.rint(F.col("epoch_duration_s") * F.col("sampling_rate")).cast("int") + 1))
    step = 1.0 / F.col("sampling_rate")
    for g in GEOMETRY:
        df = df.withColumn(f"{g}_width", F.greatest(step, F.col(f"{g}_width")))
        df = df.withColumn(f"{g}_offset", F.greatest(F.col(f"{g}_offset"), F.col(f"{g}_width") / 2 + step))
    names = [n.name for n in cfg.noise_pool]
    return df.withColumn("noiselevels", F.map_from_arrays(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>"), "levels"))


def design(params: DataFrame, seed: int) -> DataFrame:
    """The full factorial of two conditions and four numeric ones, in random presentation order with latencies."""
    axis = lambda name: F.explode(signals.levels(F.col(f"{name}_start"), F.col(f"{name}_end"), F.col("condition_levels")))
    df = params.select("rep", "mu", "sigma", "condition_levels", *[f"{n}_{e}" for n in ("one_sided_fan", "two_sided_fan", "tilted_bar", "hourglass") for e in ("start", "end")])
    df = df.withColumn("diverging_bar_condition", F.explode(F.array(F.lit("car"), F.lit("face"))))
    columns = {"hourglass_continuous": "hourglass", "one_sided_fan_duration": "one_sided_fan", "two_sided_fan_duration": "two_sided_fan", "tilted_bar_duration": "tilted_bar"}
    for column, name in columns.items():
        df = df.withColumn(column, axis(name))
    keys = ["diverging_bar_condition", *columns]
    df = matrix.ranked(df, [draws.uniform(seed, "order", "rep", *keys), *keys], ["rep"], "trial", spread=False)
    gap = F.rint(F.exp(draws.normal(seed, "onset", "rep", "trial", mean=F.col("mu"), sd=F.col("sigma"))))
    df = events.onsets(df, ["rep"], ["trial"], gap, spread=False)
    df = events.delta_latency(df, ["rep"], ["trial"], spread=False)
    return df.select("rep", "trial", *keys, "latency", "dlatency")


def responses(trials: DataFrame, params: DataFrame) -> DataFrame:
    """``response`` of each trial: three evoked components and three that vary in time, added up."""
    own = params.drop("mu", "sigma", "condition_levels")
    df = trials.join(own, "rep")
    n, rate = F.col("signal_len"), F.col("sampling_rate")
    bump = lambda g: signals.placed_hanning(F.col(f"{g}_width"), F.col(f"{g}_offset"), rate)
    face = F.when(F.col("diverging_bar_condition") == "face", 1.0).otherwise(0.0)
    n1 = -(F.col("n1_beta1") + F.col("n1_beta2") * face + F.col("n1_beta3") * F.col("hourglass_continuous"))
    # the longest duration of a rep is at an end of its range: no window over the trials
    longest = F.greatest("two_sided_fan_start", "two_sided_fan_end")
    return df.withColumn(
        "response",
        signals.added(
            signals.scaled(bump("p100"), F.col("p1_beta")),
            signals.scaled(bump("n170"), n1),
            signals.scaled(bump("p300"), F.col("p3_beta")),
            signals.scaled(signals.one_sided_fan(F.col("one_sided_fan_duration"), n), F.col("amp_a")),
            signals.scaled(signals.two_sided_fan(F.col("two_sided_fan_duration"), longest, n), F.col("amp_b")),
            signals.scaled(signals.tilted_bar(F.col("tilted_bar_duration"), n), F.col("amp_c")),
        ),
    )


def simulate(params: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(trials, epochs): the design, and each trial's overlapping, noisy samples."""
    trials = design(params, cfg.seed)
    evoked = responses(trials, params).select("rep", "trial", "latency", "levels", "response")
    n_time = F.size("response")
    epochs = events.epochs(evoked, ["rep"], n_time)
    if cfg.noise_pool:
        of = noise.pool(tuple((n.name, n.tau) for n in cfg.noise_pool), cfg.seed)
        epochs = epochs.withColumn("signal", signals.added(F.col("signal"), of("rep", "trial", F.size("signal"), "levels")))
    return trials, epochs.select("rep", "trial", "signal")


def build_images(trials: DataFrame, epochs: DataFrame, params: DataFrame, cfg: Config) -> DataFrame:
    """Seven orders times four variants of each rep's matrix, with labels and metadata."""
    start, end = matrix.crop_samples(F.size("signal"), F.col("crop_start_ms").cast("double"), F.col("crop_end_ms").cast("double"), F.col("sampling_rate").cast("double"))
    meta = params.select("rep", "crop_start_ms", "crop_end_ms", "sampling_rate", "dropout_trials_rate")
    df = epochs.join(meta, "rep").withColumn("raw_time", F.size("signal")).withColumn("crop_start_samples", start).withColumn("crop_end_samples", end)
    df = df.withColumn("signal", matrix.cropped(F.col("signal"), F.col("crop_start_samples"), F.col("crop_end_samples"))).join(trials, ["rep", "trial"])
    df = df.withColumn("pattern", F.explode(F.array(*[F.lit(p) for p in matrix.PATTERNS])))
    by = ["rep", "pattern"]
    # a rep's trials are bounded by its levels, so each matrix fits a task
    df = matrix.dropout(df, F.col("dropout_trials_rate"), cfg.seed, by, spread=False)
    df = matrix.ranked(df, [matrix.sort_key(cfg.seed)], by, spread=False)
    if cfg.zscore_timepoints:
        df = matrix.zscored(df, by)
    df = work_table(df, "matrices")
    facts = df.groupBy(*by).agg(
        F.max("raw_time").alias("raw_time"), F.max(F.size("signal")).alias("n_time"), F.count("*").alias("kept"), F.max("dropped").cast("int").alias("dropout_trials"),
        F.max("crop_start_samples").alias("crop_start_samples"), F.max("crop_end_samples").alias("crop_end_samples"),
    )
    filters = {}
    if cfg.gauss_smooth and cfg.filter_sigma > 0:
        filters |= {"sigma": cfg.filter_sigma, "length": cfg.gauss_kernel_len}
    if cfg.resize_antialias and cfg.antialias_factor > 0:
        filters |= {"antialias": cfg.antialias_factor}
    cells = matrix.resized(df.select(*by, "y", "signal"), cfg.target_height, cfg.target_width, by, cfg.resize_method, **filters)
    image = matrix.variants(matrix.images(cells, by)).join(facts, by).join(params, "rep")
    pidx = F.array_position(F.array(*[F.lit(p) for p in matrix.PATTERNS]), F.col("pattern"))
    size = lambda h, w: F.struct(h.cast("int").alias("h"), w.cast("int").alias("w"))
    image = image.withColumns(
        {
            "idx": output_index(F.col("rep"), pidx, F.col("vidx")),
            "label": F.col("pattern"),
            "erpimage_raw_size": size(F.col("kept") + F.col("dropout_trials"), F.col("raw_time")),
            "erpimage_processed_size": size(F.col("kept"), F.col("n_time")),
            "noise": F.map_keys("noiselevels"),
            "n1_betas": F.struct(F.col("n1_beta1").alias("b1"), F.col("n1_beta2").alias("b2"), F.col("n1_beta3").alias("b3")),
        }
    )
    return image.select("idx", "rep", "label", "image", *METADATA)


def generate_erp_images(spark: SparkSession, cfg: Config) -> DataFrame:
    """28 images for each of ``cfg.n_per_pattern`` reps; epochs and matrices are work tables."""
    cfg.checked()
    params = sample_params(spark.range(1, cfg.n_per_pattern + 1).withColumnRenamed("id", "rep"), cfg)
    trials, epochs = simulate(params, cfg)
    epochs = work_table(epochs, "epochs")  # one simulation feeds seven orders and their statistics
    return build_images(trials, epochs, params, cfg)
