"""Order statistics and quantiles of groups of any size, by narrowing counts: no sort and no buffer of a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_table
from .facts import with_facts

#: Steps of the grid of approximate quantiles that an interval is cut by, and the accuracy of their ranks.
GRID, ACCURACY = 500, 5000
#: Values of an interval that are collected at last.
FEW = 1000
_STATE = ("_n", "_place", "_a", "_b", "_under", "_inside", "_kth")


def order_statistic(rows: DataFrame, value: str, places: DataFrame, by: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """(by, place, kth): of each group in ``places`` the value of rank ``place`` (from 0); null where it has no such rank.

    Nulls are left out; not-a-number is the greatest value. An interval that holds the value wanted is cut by a grid of
    approximate quantiles of what lies in it; exact counts tell on or between which two grid points the value is. A
    pass leaves about three of ``GRID`` parts, and never a value twice, so ties don't stop it. ``rows`` are read in each pass.
    """
    by = list(by)
    rows = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    counted = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    wanted = places.select(*by, F.col("place").cast("long").alias("_place"))
    none = F.lit(None).cast("double")
    state = with_facts(counted, wanted, by).withColumns({"_a": none, "_b": none, "_under": F.lit(0).cast("long"), "_inside": F.col("_n"), "_kth": none})
    state = work_table(state.where("_place BETWEEN 0 AND _n - 1").select(*by, *_STATE), "places")
    while not state.where(f"_kth IS NULL AND _inside > {few}").isEmpty():
        state = work_table(_narrowed(rows, state, by, few), "places")
    found = state.where("_kth IS NOT NULL").select(*by, "_place", "_kth")
    last = state.where("_kth IS NULL")
    values = _within(rows, last, by).groupBy(*by, "_place", "_under").agg(F.array_sort(F.collect_list("_v")).alias("_values"))
    found = found.union(values.select(*by, "_place", F.get("_values", (F.col("_place") - F.col("_under")).cast("int"))))
    return found.select(*by, F.col("_place").alias("place"), F.col("_kth").alias("kth"))


def _within(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """The values in the open interval of their group."""
    return with_facts(rows, state, by).where("(_a IS NULL OR _v > _a) AND (_b IS NULL OR _v < _b)")


def _narrowed(rows: DataFrame, state: DataFrame, by: list[str], few: int) -> DataFrame:
    at = f"_kth IS NULL AND _inside > {few}"
    opened = state.where(at)
    grid = F.percentile_approx("_v", [k / GRID for k in range(GRID + 1)], ACCURACY)
    cuts = _within(rows, opened, by).groupBy(*by).agg(grid.alias("_grid"))
    step = F.floor((F.col("_place") - F.col("_under")) / F.col("_inside") * GRID).cast("int")
    point = lambda i: F.get("_grid", F.least(F.greatest(i, F.lit(0)), F.lit(GRID)))
    opened = with_facts(opened, cuts, by).withColumns({"_lo": point(step - 1), "_hi": point(step + 2)}).drop("_grid")
    number = lambda c: F.count_if(c)
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    counts = _within(rows, opened, by).groupBy(*by, *_STATE, "_lo", "_hi")
    counts = counts.agg(number(v < lo).alias("_c0"), number(v == lo).alias("_c1"), number((v > lo) & (v < hi)).alias("_c2"), number((v == hi) & (lo < hi)).alias("_c3"), number(v > hi).alias("_c4"))
    return _placed(counts, by).unionByName(state.where(f"NOT ({at})"))


def _placed(counts: DataFrame, by: list[str]) -> DataFrame:
    """The part in which the place is: below, on, between, on or above the two grid points."""
    ends, total = [F.col("_under")], F.col("_under")
    for k in range(5):
        total = total + F.col(f"_c{k}")
        ends.append(total)
    a, b, lo, hi, none = F.col("_a"), F.col("_b"), F.col("_lo"), F.col("_hi"), F.lit(None).cast("double")
    parts = [(a, lo, none), (none, none, lo), (lo, hi, none), (none, none, hi), (hi, b, none)]
    fields = lambda k, p: F.struct(p[0].alias("_a"), p[1].alias("_b"), ends[k].alias("_under"), F.col(f"_c{k}").alias("_inside"), p[2].alias("_kth"))
    chosen = fields(4, parts[4])
    for k in range(3, -1, -1):
        chosen = F.when(F.col("_place") < ends[k + 1], fields(k, parts[k])).otherwise(chosen)
    return counts.select(*by, "_n", "_place", chosen.alias("_to")).select(*by, "_n", "_place", "_to.*").select(*by, *_STATE)


def quantile(rows: DataFrame, value: str, q: float, by: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """(by, quantile): exact, between the two neighbouring values of the place q * (n - 1)."""
    by = list(by)
    rows = work_table(rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL"), "values")
    at = (F.count("*") - 1) * F.lit(float(q))
    places = rows.groupBy(*by).agg(at.alias("_at")).where("_at >= 0").select(*by, F.floor("_at").alias("place"), (F.col("_at") - F.floor("_at")).alias("_part"))
    low = order_statistic(rows, "_v", places, by, few)
    facts = with_facts(places.drop("place"), low, by)
    # the next value: the same one where it occurs again, else the least above it
    v, kth = F.col("_v"), F.col("kth")
    near = with_facts(rows, facts, by).groupBy(*by, "place", "_part", "kth").agg(F.count_if(v <= kth).alias("_upto"), F.min(F.when(v > kth, v)).alias("_above"))
    following = F.when((F.col("_upto") > F.col("place") + 1) | F.col("_above").isNull(), kth).otherwise(F.col("_above"))
    return near.select(*by, F.when(F.col("_part") == 0, kth).otherwise(kth + F.col("_part") * (following - kth)).alias("quantile"))


def first_rows(rows: DataFrame, order: Column, key: Sequence[str], counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, count, limit, last, same, spare): the ``count`` first rows of a group by (order, key) end at (limit, last).

    ``same`` rows have that very order and key, and ``spare`` of them are among the first. The limit is selected by
    counts; only keys that share it are ranked, so the order should be a hash or otherwise have few keys for one value.
    """
    by, key = list(by), list(key)
    rows = work_table(rows.select(*by, *key, order.cast("double").alias("_order")), "orders")
    places = counts.select(*by, (F.col("count") - 1).alias("place")).where("place >= 0")
    limits = order_statistic(rows, "_order", places, by)
    upto = with_facts(rows, limits, by).where("_order <= kth")
    keys = upto.groupBy(*by, "place", "kth").agg(F.count_if(F.col("_order") < F.col("kth")).alias("_less"))
    tied = upto.where("_order = kth").groupBy(*by, *key).agg(F.count("*").alias("same"))
    tied = with_facts(tied, keys, by).withColumn("_last", F.struct(*key))
    ranks = Window.partitionBy(*by or [F.lit(0)]).orderBy("_last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tied = tied.withColumn("_upto", F.col("_less") + F.sum("same").over(ranks)).where("_upto > place AND _upto - same <= place")
    return tied.select(*by, (F.col("place") + 1).alias("count"), F.col("kth").alias("limit"), F.col("_last").alias("last"), "same", (F.col("place") + 1 - F.col("_upto") + F.col("same")).alias("spare"))
