"""Sparse weights of filters and resizes along one axis: (output, input, weight), both counted from 1."""

from __future__ import annotations

import numpy as np

METHODS = ("nearest", "linear", "quadratic_line_ongrid", "cubic_line_ongrid", "lanczos4_opencv")
#: Inputs on either side of an output that a spline's prefilter takes in; beyond, weights are below 1e-17.
REACH = 32
#: Inputs on either side of an output that a method reads, without a spline's prefilter.
SPAN = {"nearest": 1, "linear": 1, "lanczos4_opencv": 4}
SPLINES = {"quadratic_line_ongrid": 2, "cubic_line_ongrid": 3}


def positions(n: int, size: int) -> np.ndarray:
    """Half-pixel centres of ``size`` outputs over inputs 1..n."""
    return np.clip((np.arange(1, size + 1) - 0.5) * n / size + 0.5, 1, n)


def gauss(sigma: float, length: int) -> np.ndarray:
    """Normalised kernel; an even length gets one more tap."""
    half = (length + (length % 2 == 0) - 1) // 2
    g = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma))
    return g / g.sum()


def reflected(i: np.ndarray, n: int) -> np.ndarray:
    """Indices mirrored at the ends; the end itself is not repeated."""
    if n == 1:
        return np.ones_like(i)
    period = 2 * n - 2
    i = (i - 1) % period
    return np.where(i >= n, period - i, i) + 1


def _spline(t: np.ndarray, degree: int) -> np.ndarray:
    a = np.abs(t)
    if degree == 2:
        return np.where(a < 0.5, 0.75 - a * a, np.where(a < 1.5, (1.5 - a) ** 2 / 2, 0.0))
    return np.where(a < 1, 2 / 3 - a * a + a**3 / 2, np.where(a < 2, (2 - a) ** 3 / 6, 0.0))


def tridiagonal(right: np.ndarray, degree: int) -> np.ndarray:
    """Solves side * x[k-1] + middle * x[k] + side * x[k+1] = right[k] along the first axis, by a recurrence there and one back."""
    side, middle, _ = _spline(np.array([-1.0, 0.0, 1.0]), degree)
    x, shares, share = np.array(right, float), [], 0.0
    for k in range(len(x)):
        pivot = middle - side * share
        share = side / pivot
        shares.append(share)
        x[k] = (x[k] - side * x[k - 1]) / pivot if k else x[k] / pivot
    for k in range(len(x) - 2, -1, -1):
        x[k] -= shares[k] * x[k + 1]
    return x


def spline_coefficients(values: np.ndarray, degree: int) -> np.ndarray:
    """Coefficients 0..n+1 of splines through values 1..n along the first axis that go on as straight lines at both ends.

    So the first and last coefficients are the values themselves, and a recurrence gives those between.
    """
    side = _spline(np.array([1.0]), degree)[0]
    c = np.array(values, float)
    if len(c) > 2:
        inner = c[1:-1].copy()
        inner[0] -= side * c[0]
        inner[-1] -= side * c[-1]
        c[1:-1] = tridiagonal(inner, degree)
    if len(c) == 1:
        return np.concatenate([c, c, c])
    return np.concatenate([2 * c[:1] - c[1:2], c, 2 * c[-1:] - c[-2:-1]])


def spline_samples(values: np.ndarray, size: int, degree: int) -> np.ndarray:
    """Rows of values resized along their last axis."""
    n = values.shape[1]
    c, p = spline_coefficients(values.T, degree), positions(n, size)
    first = np.minimum(p.astype(np.int64) - 1, n - 2) if n > 2 else np.zeros(size, np.int64)
    out = np.zeros((size, len(values)))
    for k in range(min(4, n + 2)):
        out += _spline(p - (first + k), degree)[:, None] * c[first + k]
    return out.T


def _spline_taps(n: int, size: int, degree: int, outputs: np.ndarray) -> list[tuple[int, int, float]]:
    """Weights of the values within reach: the transposed recurrence over the spline's own weights, for many outputs at once."""
    side = _spline(np.array([1.0]), degree)[0]
    p = positions(n, size)[outputs - 1]
    lo, hi = np.maximum(1, p.astype(np.int64) - REACH), np.minimum(n, p.astype(np.int64) + REACH)
    out = []
    for m in np.unique(hi - lo + 1).tolist():
        which = np.flatnonzero(hi - lo + 1 == m)
        w = _spline(p[which] - (lo[which] + np.arange(-1, m + 1)[:, None]), degree)
        if m == 1:
            w = w.sum(0, keepdims=True)
        else:  # the coefficients beyond the ends follow the straight line there
            w[1], w[2] = w[1] + 2 * w[0], w[2] - w[0]
            w[-2], w[-3] = w[-2] + 2 * w[-1], w[-3] - w[-1]
            w = w[1:-1]
            if m > 2:
                w[1:-1] = tridiagonal(w[1:-1], degree)
                w[0] -= side * w[1]
                w[-1] -= side * w[-2]
        for j, o in enumerate(outputs[which].tolist()):
            out += [(o, int(lo[which[j]]) + k, x) for k, x in enumerate(w[:, j].tolist()) if abs(x) > 1e-17]
    return out


def resize(n: int, size: int, method: str, outputs: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Of all outputs or the given ones; identity where the size is 0 or the same."""
    if outputs is None:
        outputs = np.arange(1, (n if size <= 0 else size) + 1)
    if size <= 0 or size == n:
        return [(o, o, 1.0) for o in outputs.tolist()]
    if method in SPLINES:
        return _spline_taps(n, size, SPLINES[method], outputs)
    out = []
    for o, p in zip(outputs.tolist(), positions(n, size)[outputs - 1]):
        i = int(np.floor(p))
        if method == "nearest":
            taps = {int(np.rint(p)): 1.0}
        elif method == "linear":
            taps = {i: 1.0 - (p - i)}
            if p > i:
                taps[i + 1] = p - i
        elif method == "lanczos4_opencv":
            at = np.arange(i - 3, i + 5)
            w = np.sinc(p - at) * np.sinc((p - at) / 4)
            taps = {}
            for k, x in zip(np.clip(at, 1, n).tolist(), (w / w.sum()).tolist()):
                taps[k] = taps.get(k, 0.0) + x
        else:
            raise ValueError(f"unknown resize method {method}; known: {', '.join(METHODS)}")
        out += [(o, k, float(w)) for k, w in taps.items()]
    return out


def smoothed(taps: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The taps over inputs that are smoothed first: each input spread over its neighbours, equal places added up."""
    o, i, w = taps
    half = len(kernel) // 2
    near = reflected(i[:, None] + np.arange(-half, half + 1), n)
    cell, place = np.unique(o[:, None] * (n + 1) + near, return_inverse=True)
    return cell // (n + 1), cell % (n + 1), np.bincount(place.ravel(), (w[:, None] * kernel).ravel(), len(cell))


def kernel(n: int, size: int, sigma: float = 0.0, length: int = 0, antialias: float = 0.0) -> np.ndarray:
    """A smoothing and a low-pass in one kernel; both mirror at the ends and are symmetric, so one after the other is one."""
    k = gauss(sigma, length) if sigma > 0 else np.ones(1)
    if antialias > 0 and size > 0:
        s = antialias * n / size
        k = np.convolve(k, gauss(s, 4 * int(np.ceil(s)) + 1))
    return k if n > 1 else np.ones(1)


def axis(n: int, size: int, method: str = "linear", sigma: float = 0.0, length: int = 0, antialias: float = 0.0, outputs: np.ndarray | None = None, filtered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(outputs, inputs, weights) of a smoothing, a low-pass and a resize together, for all outputs or the given ones.

    With ``filtered`` the resize itself is left out.
    """
    rows = np.array(resize(n, 0 if filtered else size, method, outputs), dtype=float).reshape(-1, 3)
    taps = rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64), rows[:, 2]
    k = kernel(n, size, sigma, length, antialias)
    return smoothed(taps, n, k) if len(k) > 1 else taps


def stencil(n: int, size: int, method: str, k: np.ndarray, outputs: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """Weights outputs x inputs of a kernel and a resize: of the given outputs, over some of the inputs only."""
    o, i, w = (np.array(x) for x in zip(*resize(n, size, method, outputs)))
    half, out = len(k) // 2, np.zeros((len(outputs), len(inputs)))
    each = max(1, len(outputs) * 1024 // len(o))
    for s in range(0, len(outputs), each):
        mine = (o >= outputs[s]) & (o <= outputs[min(s + each, len(outputs)) - 1])
        place, at = np.unique(i[mine], return_inverse=True)
        spread = np.zeros((len(place), len(inputs)))
        for mirrored in _mirrored(inputs, n, place[0] - half, place[-1] + half):
            d = mirrored - place[:, None] + half
            spread += np.where((d >= 0) & (d < len(k)), k[np.clip(d, 0, len(k) - 1)], 0.0)
        share = np.zeros((min(each, len(outputs) - s), len(place)))
        np.add.at(share, (o[mine] - outputs[s], at), w[mine])
        out[s : s + each] = share @ spread
    return out


def _mirrored(inputs: np.ndarray, n: int, low: int, high: int):
    """Where inputs 1..n come again on a line that is mirrored at both ends; places far off ``low``..``high`` are left out."""
    far, period = low - n * 4 - 4, max(2 * n - 2, 1)
    ends = (inputs == 1) | (inputs == n)
    for t in range((low - n) // period, (high + n) // period + 1) if n > 1 else [0]:
        for places in (inputs + t * period, np.where(ends, far, 2 - inputs + t * period)):
            inside = (places >= low) & (places <= high)
            if inside.any():
                yield np.where(inside, places, far)
