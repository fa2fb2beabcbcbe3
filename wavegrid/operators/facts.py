"""Joins of rows with what is known of their group, and the check of a group's size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group that one task's window may take.
GROUP_ROWS = 2_000_000


def crowded(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether a group has more rows than a task should take; without ``by`` all rows are one group, which may have any number."""
    return not by or not df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP_ROWS).isEmpty()


def with_facts(df: DataFrame, facts: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of its group's row in ``facts``; a null in ``by`` is a value like others.

    Without ``by`` there is one row of facts, which is broadcast.
    """
    if not by:
        return df.join(F.broadcast(facts), how=how) if how == "inner" else df.join(F.broadcast(facts), F.lit(True), how)
    facts = facts.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return df.join(facts, same, how).drop(*[f"_of_{c}" for c in by])
