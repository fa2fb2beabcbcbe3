"""Settings of a simulation: distributions, noise pool, rendering."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from ..functions.taps import METHODS


@dataclass(frozen=True)
class Dist:
    """normal(a, b): mean and deviation; uniform(a, b): integers from a to b."""

    kind: str
    a: float
    b: float


def N(mean: float, sd: float) -> Dist:  # noqa: N802
    return Dist("normal", mean, sd)


@dataclass(frozen=True)
class Noise:
    name: str
    level: Dist | None
    tau: float = 10.0


NOISES = ("PinkNoise", "WhiteNoise", "RedNoise", "ExponentialNoise")


@dataclass(frozen=True)
class Config:
    """Defaults of every parameter (fixed values); times of crops in ms, geometry in seconds, durations in samples."""

    n_per_pattern: int = 10
    mu: Dist = N(3.2, 0.3)
    sigma: Dist = N(0.5, 0.1)
    condition_levels: Dist = Dist("uniform", 3, 10)
    sampling_rate: Dist = N(100, 5)
    epoch_duration_s: Dist = N(1, 0.25)
    dropout_trials_rate: Dist = N(2000, 250)
    crop_start: Dist = N(100, 25)
    crop_end: Dist = N(100, 25)
    p100_width: Dist = N(0.1, 0.015)
    p100_offset: Dist = N(0.1, 0.015)
    p300_width: Dist = N(0.3, 0.045)
    p300_offset: Dist = N(0.3, 0.045)
    n170_width: Dist = N(0.15, 0.0225)
    n170_offset: Dist = N(0.17, 0.0255)
    p1_beta: Dist = N(5, 1)
    p3_beta: Dist = N(5, 0.75)
    n1_beta1: Dist = N(5, 0.75)
    n1_beta2: Dist = N(3, 0.45)
    n1_beta3: Dist = N(2, 0.3)
    amp_a: Dist = N(5, 1)
    amp_b: Dist = N(-10, 1)
    amp_c: Dist = N(5, 1)
    one_sided_fan_start: Dist = N(20, 3)
    one_sided_fan_end: Dist = N(100, 15)
    two_sided_fan_start: Dist = N(10, 1.5)
    two_sided_fan_end: Dist = N(30, 4.5)
    tilted_bar_start: Dist = N(5, 0.75)
    tilted_bar_end: Dist = N(40, 6)
    hourglass_start: Dist = N(-2, 0.3)
    hourglass_end: Dist = N(2, 0.3)
    noise_pool: tuple[Noise, ...] = field(default_factory=lambda: tuple(Noise(n, N(15, 2)) for n in NOISES))
    target_height: int = 64
    target_width: int = 64
    zscore_timepoints: bool = True
    gauss_smooth: bool = False
    filter_sigma: float = 1.0
    gauss_kernel_len: int = 20
    resize_antialias: bool = False
    antialias_factor: float = 0.75
    resize_method: str = "linear"
    seed: int = 1

    def checked(self) -> Config:
        """Raises before any job runs where a setting can't work."""
        lowest = self.condition_levels.a if self.condition_levels.kind == "uniform" else 2
        if lowest < 2:
            raise ValueError("condition_levels must be at least 2: a range of one level has no two ends")
        if self.epoch_duration_s.a <= 0:
            raise ValueError("epoch_duration_s must be > 0")
        if self.resize_method not in METHODS:
            raise ValueError(f"unknown resize method {self.resize_method}; known: {', '.join(METHODS)}")
        for n in self.noise_pool:
            if n.level is None:
                raise ValueError(f"Missing noise level distribution for {n.name}")
            if n.name not in NOISES:
                raise ValueError(f"unknown noise {n.name}; known: {', '.join(NOISES)}")
        return self

    def settings(self) -> dict:
        return asdict(self)


def with_noiselevel(noise: Noise, level: float) -> Noise:
    """A copy with a fixed level."""
    return replace(noise, level=N(level, 0.0))


#: Narrow component geometry of the two preview configurations (fixed values).
_NARROW = dict(
    n_per_pattern=1, mu=N(3.2, 0.1), sigma=N(0.5, 0.05), sampling_rate=N(350, 5), epoch_duration_s=N(1, 0.05), dropout_trials_rate=N(50, 10),
    p100_width=N(0.01, 0.015), p300_width=N(0.03, 0.045), n170_width=N(0.015, 0.0225), one_sided_fan_start=N(20, 0.2), two_sided_fan_start=N(10, 0.2),
    tilted_bar_end=N(40, 0.5), hourglass_start=N(-2, 0.05), hourglass_end=N(2, 0.05), crop_start=N(0, 5), resize_antialias=True,
    noise_pool=tuple(Noise(n, N(1, 0.05)) for n in NOISES),
)
DEFAULT = Config()
OVERVIEW = Config(**_NARROW, condition_levels=Dist("uniform", 8, 8), one_sided_fan_end=N(100, 0.5), two_sided_fan_end=N(30, 0.5), tilted_bar_start=N(5, 0.1), crop_end=N(0, 5))
TEST = Config(**_NARROW, condition_levels=Dist("uniform", 6, 8), one_sided_fan_end=N(10, 0.5), two_sided_fan_end=N(15, 0.5), tilted_bar_start=N(10, 0.1), crop_end=N(200, 50))
BULK = Config(
    n_per_pattern=1000, mu=N(3.2, 1), sigma=N(0.5, 0.2), condition_levels=Dist("uniform", 8, 8), resize_antialias=True,
    noise_pool=tuple(Noise(n, N(5, 2)) for n in NOISES),
)
TINY = Config(
    n_per_pattern=1, condition_levels=Dist("uniform", 3, 3), sampling_rate=N(100, 0), epoch_duration_s=N(1, 0), dropout_trials_rate=N(12, 0),
    target_height=16, target_width=16,
)
