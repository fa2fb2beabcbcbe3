"""Noise of unit variance per trial, by name. White noise and random walks are expressions, the others Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import draws


def white(seed: int, n: Column, *keys: Column | str) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda t: draws.normal(seed, "white", *keys, t))


def red(seed: int, n: Column, *keys: Column | str) -> Column:
    """A random walk over white noise, of variance t at sample t."""
    step = F.transform(F.sequence(F.lit(1), n), lambda t: draws.normal(seed, "red", *keys, t))
    walk = F.aggregate(step, F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.slice(walk, F.lit(2), n)


def _generator(seed: int, *key: int) -> np.random.Generator:
    return np.random.default_rng([abs(int(seed)), *[abs(int(k)) for k in key]])


def _standard(x: np.ndarray) -> np.ndarray:
    sd = x.std()
    return (x - x.mean()) / sd if sd > 0 else x * 0


def coloured(rng: np.random.Generator, n: int, exponent: float) -> np.ndarray:
    """Gaussian noise whose power falls as 1 / f ** exponent."""
    f = np.fft.rfftfreq(n)
    f[0] = f[1] if n > 1 else 1
    spectrum = (rng.standard_normal(len(f)) + 1j * rng.standard_normal(len(f))) / f ** (exponent / 2)
    spectrum[0] = 0
    return _standard(np.fft.irfft(spectrum, n)) if n > 1 else np.zeros(n)


def exponential(rng: np.random.Generator, n: int, tau: float) -> np.ndarray:
    """Gaussian noise with autocorrelation exp(-lag / tau): the Cholesky factor of its Toeplitz matrix is a recursion."""
    r = np.exp(-1.0 / tau)
    x = rng.standard_normal(n)
    for k in range(1, n):
        x[k] = r * x[k - 1] + np.sqrt(1 - r * r) * x[k]
    return x


def realisation(name: str, rng: np.random.Generator, n: int, tau: float = 10.0) -> np.ndarray:
    if name == "WhiteNoise":
        return rng.standard_normal(n)
    if name == "PinkNoise":
        return coloured(rng, n, 1.0)
    if name == "RedNoise":
        return coloured(rng, n, 2.0)
    if name == "ExponentialNoise":
        return exponential(rng, n, tau)
    raise ValueError(f"unknown noise {name}")


def noise(name: str, seed: int, stream: int = 0, tau: float = 10.0):
    """An Arrow function of (rep, trial, n): n samples of one independent realisation for each trial."""

    @pandas_udf("array<double>")
    def of(rep: pd.Series, trial: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([realisation(name, _generator(seed, stream, r, t), int(k), tau) for r, t, k in zip(rep, trial, n)])

    return of


def pool(entries: tuple[tuple[str, float], ...], seed: int):
    """An Arrow function of (rep, trial, n, levels): the sum of all noises, each scaled by its level."""

    @pandas_udf("array<double>")
    def of(rep: pd.Series, trial: pd.Series, n: pd.Series, levels: pd.Series) -> pd.Series:
        out = []
        for r, t, k, level in zip(rep, trial, n, levels):
            total = np.zeros(int(k))
            for stream, ((name, tau), x) in enumerate(zip(entries, level)):
                if x > 0:
                    total += x * realisation(name, _generator(seed, stream, r, t), int(k), tau)
            out.append(total)
        return pd.Series(out)

    return of
