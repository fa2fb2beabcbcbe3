"""Quality classifier: naive Bayes support vectors.

*Features.* Indicators, hashed to ``BUCKETS`` bins, of words, of pairs of neighbouring words and of pairs of their
shapes (``quality_rules.bins``: case, punctuation and digits stay, runs of letters shrink), and of how much of a text
repeats the word before it. *Scaling.* Each indicator is scaled by the log ratio of its smoothed counts in the two
classes. *Fit.* A linear model with hinge loss, by dual coordinate descent over the sampled rows, which are at most
``labelled.LABELLED_ROWS``; a logistic curve turns margins into scores.

The scaled weights are one constant array, so scoring every text is a projection without a shuffle or a join.

Defined results: empty and null texts have no indicator but the constant and get its score; without both classes
among the labels every score is 0.5; rows with a null doc_id are left out; a doc_id with several
texts has a row for each, and its label counts for each.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .labelled import LABELLED_ROWS, calibrated, fold, sample
from .quality_rules import bins as ngrams

BUCKETS = 1 << 18
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


def indicators(text: Column) -> Column:
    """The distinct bins of a text."""

    def of(h: Column) -> Column:
        n = F.size(h)
        same = F.size(F.filter(h, lambda x, i: (i > 0) & (F.get(h, i - 1) == x)))
        share = F.floor(F.log2((same + 0.01) / (n + 1)) / 2)
        repeats = F.pmod(F.xxhash64(F.lit("same"), share), F.lit(BUCKETS))
        return F.array_distinct(F.concat(ngrams(text, BUCKETS - 1), F.array(repeats)))

    return C.let(C.word_hashes(text), of)


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 15) -> np.ndarray:
    """Weights of a linear hinge-loss model; row i has ``values`` at its bins and a constant 1 at the last place."""
    w, alpha, rng = np.zeros(len(values) + 1), np.zeros(len(y)), np.random.default_rng(3)
    square = np.array([(values[r] ** 2).sum() + 1 for r in rows])
    upper = cost * np.where(y > 0, max(1.0, (y < 0).sum() / max(1, (y > 0).sum())), max(1.0, (y > 0).sum() / max(1, (y < 0).sum())))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r = rows[i]
            v = values[r]
            gradient = y[i] * (w[r] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                w[-1] += step
                moved = max(moved, abs(step) * square[i] ** 0.5)
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Model:
    """Bin weights (ratio times weight), and the logistic curve over their sum."""

    def __init__(self, weights: np.ndarray, constant: float, slope: float, offset: float):
        self.weights, self.constant, self.slope, self.offset = weights, constant, slope, offset

    def score(self, text: Column) -> Column:
        table = F.from_json(F.lit(json.dumps([float(f"{w:.5g}") for w in self.weights])), "array<double>")
        margin = F.aggregate(indicators(text), F.lit(self.constant), lambda s, i: s + table[i])
        return 1.0 / (1.0 + F.exp(F.least(F.lit(50.0), -(margin * self.slope + self.offset))))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = LABELLED_ROWS) -> Model:
    C.small_batches(docs.sparkSession)
    got = sample(docs, labels, column, folds, held_out, rows).select("label", indicators(F.col("text")).cast("array<int>").alias("bins")).toArrow()
    y = np.where(got.column("label").to_numpy() == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 0.0)
    bins = [b for c in got.column("bins").chunks for b in np.split(c.flatten().to_numpy(), c.offsets.to_numpy()[1:-1] - c.offsets[0].as_py())]
    good, bad = np.ones(BUCKETS), np.ones(BUCKETS)
    for b, sign in zip(bins, y):
        (good if sign > 0 else bad)[b] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    w = dual_coordinate_descent(bins, ratio, y)
    weights = ratio * w[:-1]
    margin = np.array([weights[b].sum() for b in bins]) + w[-1]
    return Model(weights, float(w[-1]), *calibrated(margin, y > 0))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    return C.documents(docs).select("doc_id", model.score(F.col("text")).alias("score"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    df = scored(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return df.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
