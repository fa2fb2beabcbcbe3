"""A bounded sample of labelled rows, and what both classifiers need to learn from it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: At most this many labelled documents are learnt from, those of least hash; a broadcast of 16 bytes for each.
LABELLED_ROWS = 20_000
#: Values of sparse rows that are worked on at once.
BLOCK_VALUES = 1 << 19


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, rows: int = LABELLED_ROWS) -> DataFrame:
    """(text, label) of the sampled documents; labels other than 0 and 1 are left out, of repeated ones the greatest counts."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).where(fold(F.col("doc_id"), folds) != held_out)
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return C.documents(docs).join(F.broadcast(own), "doc_id").select("doc_id", "text", "label")


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the margins, by Newton steps with a little ridge."""
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = logistic(x, y.astype(float), 1e-3)
    return float(w[0]), float(w[1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression on soft labels, by Newton steps that are halved until the loss falls."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge * (w @ w) / 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        while (new := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if new > now:
            break
        w, done = w - step, now - new < 1e-9 * (1 + abs(now))
        now = new
        if done:
            break
    return w


def row_blocks(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with about ``BLOCK_VALUES`` values each, so that what is computed from them stays small."""
    cuts = np.searchsorted(offsets, np.arange(0, offsets[-1], BLOCK_VALUES)[1:])
    ends = np.unique(np.concatenate([[0], cuts, [len(offsets) - 1]])).tolist()
    return list(zip(ends, ends[1:]))


def row_sums(flat: np.ndarray, offsets: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum of each row's weights and the constant, the last of ``w``."""
    out = np.full(len(offsets) - 1, w[-1])
    for a, z in row_blocks(offsets):
        row = np.repeat(np.arange(z - a), np.diff(offsets[a : z + 1]))
        out[a:z] += np.bincount(row, weights=w[flat[offsets[a] : offsets[z]]], minlength=z - a)
    return out


def logistic_sparse(flat: np.ndarray, offsets: np.ndarray, y: np.ndarray, features: int, ridge: float, steps: int = 30) -> np.ndarray:
    """The same over 0/1 features: row i has those numbered ``flat[offsets[i]:offsets[i + 1]]``, and a constant, which
    is the last weight. Newton steps, each solved by conjugate gradients."""
    up = lambda w: row_sums(flat, offsets, w)

    def down(v: np.ndarray) -> np.ndarray:
        out = np.zeros(features)
        for a, z in row_blocks(offsets):
            out += np.bincount(flat[offsets[a] : offsets[z]], weights=np.repeat(v[a:z], np.diff(offsets[a : z + 1])), minlength=features)
        return np.append(out, v.sum())

    def loss(w: np.ndarray) -> float:
        z = up(w)
        return float((np.logaddexp(0, z) - y * z).sum() + ridge * (w @ w) / 2)

    w = np.zeros(features + 1)
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(up(w), -30, 30)))
        gradient, curve = down(p - y) + ridge * w, p * (1 - p)
        step, rest = np.zeros_like(w), gradient.copy()
        along, size = rest.copy(), rest @ rest
        for _ in range(50):
            bent = down(curve * up(along)) + ridge * along
            a = size / (along @ bent)
            step, rest = step + a * along, rest - a * bent
            size, before = rest @ rest, size
            if size < 1e-8 * (gradient @ gradient) + 1e-16:
                break
            along = rest + size / before * along
        while (new := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if new > now:
            break
        w, done = w - step, now - new < 1e-7 * (1 + abs(now))
        now = new
        if done:
            break
    return w
