"""The grid of repetitions, patterns and variants: places in it, and its cells' first images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matrix import PATTERNS, VARIANTS


def output_index(rep: Column, pattern: Column, variant: Column, patterns: int = len(PATTERNS), variants: int = len(VARIANTS)) -> Column:
    """An image's number from 1: all variants of a pattern follow each other, then all patterns of a repetition."""
    return ((rep - 1) * patterns * variants + (pattern - 1) * variants + variant).cast("long")


def grid_place(index: Column, patterns: int = len(PATTERNS), variants: int = len(VARIANTS)) -> Column:
    """(rep, pattern, variant) of an image's number; the inverse of ``output_index``."""
    at = index.cast("long") - 1
    return F.struct(
        (F.floor(at / (patterns * variants)) + 1).cast("int").alias("rep"),
        (F.floor(F.pmod(at, F.lit(patterns * variants)) / variants) + 1).cast("int").alias("pattern"),
        (F.pmod(at, F.lit(variants)) + 1).cast("int").alias("variant"),
    )


def first_per_cell(images: DataFrame, cells: Sequence[str], index: str = "idx") -> DataFrame:
    """(cells, index): the least index of each cell that has an image; cells without one have no row.

    An aggregation, so a cell with a large share of the images costs a task one row for each task before it.
    """
    return images.groupBy(*cells).agg(F.min(index).alias(index)).where(F.col(index).isNotNull())


def empty_cells(grid: DataFrame, images: DataFrame, cells: Sequence[str]) -> DataFrame:
    """The cells of a grid that no image lies in."""
    return grid.join(images.select(*cells).distinct(), list(cells), "left_anti")
