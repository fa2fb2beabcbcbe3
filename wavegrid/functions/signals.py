"""Array-valued expressions: windows, component bases, noise-free responses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)).cast("int"))


def hanning(n: Column) -> Column:
    """Symmetric window of n samples; one sample is [1], two are [0, 0]."""
    w = F.transform(F.sequence(F.lit(0), n - 1), lambda i: 0.5 * (1.0 - F.cos(2.0 * math.pi * i / F.greatest(n - 1, F.lit(1)))))
    return F.when(n <= 0, F.array().cast("array<double>")).when(n == 1, F.array(F.lit(1.0))).otherwise(w)


def placed_hanning(width: Column, offset: Column, rate: Column) -> Column:
    """A window of ``width`` seconds whose centre lies ``offset`` seconds after the start."""
    n = F.rint(width * rate).cast("int")
    return F.concat(zeros(F.rint(offset * rate - n / 2.0).cast("int")), hanning(n))


def fitted(basis: Column, n: Column) -> Column:
    """Padded with zeros at the end, or cut, to n samples."""
    return F.slice(F.concat(basis, zeros(n - F.size(basis))), F.lit(1), n.cast("int"))


def tilted_bar(shift: Column, n: Column, width: int = 50) -> Column:
    """A window that moves later by ``shift`` samples."""
    return fitted(F.concat(zeros(F.rint(shift).cast("int")), hanning(F.lit(width))), n)


def two_sided_fan(duration: Column, longest: Column, n: Column) -> Column:
    """Windows of the given durations around a common centre."""
    front = (F.rint(longest - duration).cast("int") / 2).cast("int")
    return fitted(F.concat(zeros(front), hanning(F.rint(duration).cast("int"))), n)


def one_sided_fan(duration: Column, n: Column) -> Column:
    """Log-normal density on 0..10, its greatest grid value scaled to 1."""
    m = duration / 40.0 - 0.2

    def density(i: Column) -> Column:
        x = 10.0 * i / F.greatest(n - 1, F.lit(1))
        return F.when(x <= 0, F.lit(0.0)).otherwise(F.exp(-F.pow(F.ln(x) - m, F.lit(2.0)) / 2.0) / (x * math.sqrt(2.0 * math.pi)))

    raw = F.transform(F.sequence(F.lit(0), n - 1), density)
    return F.transform(F.array(raw), lambda d: F.transform(d, lambda v: F.try_divide(v, F.array_max(d))))[0]


def scaled(signal: Column, by: Column) -> Column:
    return F.transform(signal, lambda v: v * by)


def added(*signals: Column) -> Column:
    """Elementwise sum; shorter ones count as zero beyond their end."""
    total = signals[0]
    for s in signals[1:]:
        total = F.zip_with(total, s, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    return total


def levels(start: Column, stop: Column, n: Column) -> Column:
    """n evenly spaced values from start to stop, ends included."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: start + k * (stop - start) / F.greatest(n - 1, F.lit(1)))
