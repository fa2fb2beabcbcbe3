"""Joins of points with the intervals that hold them, in bins of the intervals' own sizes, and totals of each interval without pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_table
from .facts import with_facts
from .matrix import ranked

#: Points of a bin that one task takes.
HOT = 200_000
#: Bits of a child's number among its siblings.
FAN = 4


def _level(length: Column) -> Column:
    """The least power of two that isn't below the number of places of an interval."""
    return F.when(length <= 0, 0).otherwise(F.length(F.bin(length)).cast("int"))


def _bin(place: Column, level: Column) -> Column:
    """Floor of place / 2^level."""
    return F.call_function("shiftright", place, level)


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: Sequence[str] = (), hot: int = HOT) -> DataFrame:
    """Every pair of a point and an interval of the same ``by`` with start <= at <= end, whole numbers both ends included.

    An interval lies in two bins at most of the first power of two that is not shorter than it; a point lies in one bin of
    each size that intervals have. So a long interval has no row for each place in it, and a short one meets no
    points of a wide bin. Points of a bin with more than ``hot`` of them are dealt to several tasks, and its intervals
    to each of these. Both tables are read twice. Columns other than ``by`` must have different names; a null place, end or
    ``by`` is in no pair.
    """
    by = list(by)
    whole = reduce_and([F.col(c).isNotNull() for c in by])
    spans = intervals.where(whole & (F.col(start) <= F.col(end))).withColumn("_level", _level(F.col(end) - F.col(start)))
    levels = [r[0] for r in spans.select("_level").distinct().collect()]  # 64 at most
    if not levels:
        levels = [0]
    level = F.col("_level")
    spans = spans.withColumn("_bin", F.explode(F.array_distinct(F.array(_bin(F.col(start), level), _bin(F.col(end), level)))))
    dealt = points.where(whole & F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)])))
    dealt = dealt.withColumn("_bin", _bin(F.col(at), level))
    cell = [*by, "_level", "_bin"]
    crowded = dealt.groupBy(*cell).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    crowded = work_table(crowded.select(*cell, F.ceil(F.col("_n") / hot).cast("int").alias("_shares")), "crowded-bins")
    shares = F.coalesce("_shares", F.lit(1))
    dealt = with_facts(dealt, crowded, cell, "left").withColumn("_share", F.pmod(F.xxhash64(*points.columns), shares).cast("int")).drop("_shares")
    spans = with_facts(spans, crowded, cell, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    pairs = dealt.join(spans, [*cell, "_share"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)))
    return pairs.drop("_level", "_bin", "_share")


def _parts(lo: Column, hi: Column, levels: int) -> Column:
    """array<struct<_level, _parent, _from, _to>>, with nulls: runs of sibling nodes that together are the leaves lo to hi.

    At each level what sticks out on the left and on the right of whole parents, two runs at most; the parents between
    are the run of the next level.
    """
    runs = []
    for k in range(levels):
        left, right = F.shiftright(lo, FAN), F.shiftright(hi, FAN)
        run = lambda parent, a, z: F.struct(F.lit(k).alias("_level"), parent.alias("_parent"), a.alias("_from"), z.alias("_to"))  # noqa: E731, B023
        last = F.when(left == right, hi).otherwise(F.shiftleft(left, FAN) + (1 << FAN) - 1)
        runs += [F.when(lo <= hi, run(left, lo, last)), F.when((lo <= hi) & (left < right), run(right, F.shiftleft(right, FAN), hi))]
        lo, hi = left + 1, right - 1
    return F.array(*runs)


def interval_totals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, totals: Mapping[str, tuple[str, str]], hot: int = HOT) -> DataFrame:
    """``intervals`` with totals of the points in each, start <= at <= end, both ends included; no pairs are made.

    ``totals`` gives each new column's kind (count, sum, min or max) and the column of ``points`` that it is of. Places of
    points and ends of intervals are numbered in their order and are the leaves of a tree with 2^FAN children a node, whose
    totals come from its children's. An interval is some runs of siblings, two at most for each level, so its work grows
    with the logarithm of the places, not with its points. Equal intervals are looked up once; a node whose runs are more
    than ``hot`` is copied to several tasks. Totals are merged by adding only, never by subtracting, so a NaN or an
    infinite value stays within its own intervals. An interval without points, or with a null end, has no row.
    """
    merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    totals = {"_points": ("count", at), **totals}
    merged = [merge[kind](name).alias(name) for name, (kind, _) in totals.items()]
    spans = intervals.where(F.col(start) <= F.col(end))
    asked = spans.select(F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end")).distinct()
    held = points.where(F.col(at).isNotNull()).groupBy(F.col(at).cast("long").alias("_at")).agg(*[getattr(F, kind)(of).alias(name) for name, (kind, of) in totals.items()])
    ends = asked.select(F.explode(F.array("_start", "_end")).alias("_at")).distinct()
    places = ranked(held.unionByName(ends, allowMissingColumns=True).groupBy("_at").agg(*merged), ["_at"], name="_unit").withColumn("_unit", F.col("_unit").cast("long"))
    last = places.agg(F.max("_unit")).first()[0] or 0
    levels = 1
    while last >> FAN * levels:
        levels += 1

    place = lambda at, name: places.select(F.col("_at").alias(at), F.col("_unit").alias(name))
    asked = work_table(asked.join(place("_start", "_lo"), "_start").join(place("_end", "_hi"), "_end"), "intervals")
    parts = asked.select("_start", "_end", F.explode(_parts(F.col("_lo"), F.col("_hi"), levels)).alias("_part")).where("_part IS NOT NULL").select("_start", "_end", "_part.*")

    leaves = places.select(F.lit(0).alias("_level"), "_unit", *totals)
    parents = leaves.groupBy(F.shiftright("_unit", FAN).alias("_unit")).agg(*merged)
    higher = parents.withColumn("_level", F.explode(F.sequence(F.lit(1), F.lit(max(1, levels - 1)))))
    up = F.call_function("shiftright", F.col("_unit"), (F.col("_level") - 1) * FAN)
    nodes = leaves.unionByName(higher.groupBy("_level", up.alias("_unit")).agg(*merged)).withColumn("_parent", F.shiftright("_unit", FAN))

    node = ["_level", "_parent"]
    crowded = parts.groupBy(*node).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    crowded = work_table(crowded.select(*node, F.ceil(F.col("_n") / hot).cast("int").alias("_shares")), "crowded-nodes")
    shares = F.coalesce("_shares", F.lit(1))
    parts = with_facts(parts, crowded, node, "left").withColumn("_share", F.pmod(F.xxhash64("_start", "_end"), shares).cast("int")).drop("_shares")
    nodes = with_facts(nodes, crowded, node, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    met = parts.join(nodes, [*node, "_share"]).where(F.col("_unit").between(F.col("_from"), F.col("_to")))
    found = met.groupBy("_start", "_end").agg(*merged).where("_points > 0").drop("_points")
    return spans.join(found, (F.col(start) == F.col("_start")) & (F.col(end) == F.col("_end"))).drop("_start", "_end")


def reduce_and(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
