"""Joins that must match: an error names what one side lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _named(keys: Sequence[str]) -> Column:
    return F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])


def _or_error(df: DataFrame, bad: Column, message: Column, columns: Sequence[str]) -> DataFrame:
    """Each of the columns raises the error in a bad row, so that whatever is read of the row does."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[F.when(bad, F.raise_error(message).cast(kinds[c])).otherwise(F.col(c)).alias(c) for c in columns])


def aligned(trials: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trials with the columns of their values, one to one.

    Rows that lack their other side, share their key with another row of their side or have a null key raise an error
    when they are read. One shuffle of both sides by the keys joins them and counts them.
    """
    keys = list(keys)
    joined = trials.withColumn("_trial", F.lit(True)).join(values.withColumn("_value", F.lit(True)), keys, "full_outer")
    joined = joined.withColumn("_times", F.count("*").over(Window.partitionBy(*keys)))
    what = F.when(F.col("_value").isNull(), "no value for trial ").when(F.col("_trial").isNull(), "no trial for the value of ").otherwise("more than one row for trial ")
    bad = F.col("_value").isNull() | F.col("_trial").isNull() | (F.col("_times") > 1)
    return _or_error(joined, bad, F.concat(what, _named(keys)), [c for c in joined.columns if c not in ("_trial", "_value", "_times")])


def looked_up(df: DataFrame, pool: DataFrame, keys: Sequence[str], what: str = "entry") -> DataFrame:
    """``df`` with the columns of its key's row in ``pool``, whose keys are distinct; a key without one raises an error that names it."""
    keys = list(keys)
    joined = df.join(pool.withColumn("_found", F.lit(True)), keys, "left")
    return _or_error(joined, F.col("_found").isNull(), F.concat(F.lit(f"missing {what} for "), _named(keys)), [c for c in joined.columns if c != "_found"])


def missing_keys(df: DataFrame, pool: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n): keys that ``pool`` lacks, with the number of their rows; counted before the join."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).join(pool.select(*keys), list(keys), "left_anti")
