"""The image of a trials x time matrix: dropout, order, z-scores, filters and size in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import matrix
from .diagnostics import Diagnostics

#: Steps that are counted where diagnostics are on (fixed values).
SORTED, RESIZED = "erpimage_sorted", "resize_img"


def erp_image(trials: DataFrame, keys: Sequence[str], height: int, width: int, by: Sequence[str] = (), rate: Column | None = None, seed: int = 0, drop_by: Sequence[str] = (), zscore: bool = True, method: str = "linear", diagnostics: Diagnostics | None = None, **filters) -> DataFrame:
    """Long cells (by, y, x, v); ``rate`` trials of each group of ``drop_by`` are dropped, ``keys`` order the rest.

    With diagnostics on, the trials that are sorted and the rows of the resized image are counted in the tasks.
    """
    diagnostics = diagnostics or Diagnostics()
    df = matrix.guarded(trials, keys)
    if rate is not None:
        df = matrix.dropout(df, rate, seed, drop_by, spread=True)
    df = matrix.with_sizes(diagnostics.step(SORTED, matrix.ranked(df, keys, by)), by)
    cells = matrix.resized(matrix.zscored(df, by) if zscore else df, height, width, by, method, **filters)
    return diagnostics.step(RESIZED, cells.select(*by, "y", "x", F.col("v")))
