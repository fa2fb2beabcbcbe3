"""Interval joins, joins that must match, datasets that are whole, and metrics from tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wavegrid.operators import alignment, intervals
from wavegrid.plans import images
from wavegrid.plans.config import Config
from wavegrid.plans.diagnostics import Diagnostics, totals
from wavegrid.queries import queries
from wavegrid.sources import dataset


@pytest.mark.parametrize("hot", [1, 7, 200_000])
def test_interval_join(spark, hot):
    r = random.Random(hot)
    points = [(k, r.choice(["a", "b", None]), r.choice([None, 0, 5, r.randrange(-200, 200), 1 << 40])) for k in range(120)]
    spans = [(k, r.choice(["a", "b", "c", None]), s := r.randrange(-300, 300), s + r.choice([-1, 0, 1, 2, 7, 8, 63, 64, 500, 1 << 41])) for k in range(40)]
    p = spark.createDataFrame(points, "point int, g string, place long").repartition(3)
    s = spark.createDataFrame([*spans, (90, "a", None, 5), (91, "a", 5, None)], "span int, g string, opens long, closes long").repartition(2)
    got = sorted((x["point"], x["span"]) for x in intervals.interval_join(p, s, "place", "opens", "closes", ["g"], hot).collect())
    assert got == sorted((k, i) for k, g, at in points for i, h, a, b in spans if g is not None and g == h and at is not None and a <= at <= b)
    every = sorted((x["point"], x["span"]) for x in intervals.interval_join(p.drop("g"), s.drop("g"), "place", "opens", "closes", hot=hot).collect())
    assert every == sorted((k, i) for k, _, at in points for i, _, a, b in spans if at is not None and a <= at <= b)


def test_interval_join_of_nothing(spark):
    p = spark.createDataFrame([(1, 5)], "point int, place long")
    s = spark.createDataFrame([(1, 0, 9)], "span int, opens long, closes long")
    assert intervals.interval_join(p.limit(0), s, "place", "opens", "closes").collect() == []
    assert intervals.interval_join(p, s.limit(0), "place", "opens", "closes").collect() == []


def test_long_intervals_have_two_bins_at_most(spark):
    s = spark.createDataFrame([(1, 0, 1 << 50)], "span int, opens long, closes long")
    p = spark.createDataFrame([(1, 7)], "point int, place long")
    plan = intervals.interval_join(p, s, "place", "opens", "closes")
    assert plan.count() == 1 and "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_aligned(spark):
    trials = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "trial int, signal array<double>")
    values = lambda *rows: spark.createDataFrame(list(rows), "trial int, value double")
    assert sorted(map(tuple, alignment.aligned(trials, values((2, 5.0), (1, None)), ["trial"]).collect())) == [(1, [1.0], None), (2, [2.0], 5.0)]
    for rows, message in ((((1, 1.0),), "no value for trial 2"), (((1, 1.0), (2, 2.0), (3, 3.0)), "no trial for the value of 3"), (((1, 1.0), (2, 2.0), (2, 3.0)), "more than one row for trial 2"), (((1, 1.0), (2, 1.0), (None, 2.0)), "no trial for the value of null")):
        for column in ("signal", "value", "trial"):
            with pytest.raises(Exception, match=message):
                alignment.aligned(trials, values(*rows), ["trial"]).select(column).collect()
    with pytest.raises(Exception, match="more than one row for trial 1"):
        alignment.aligned(trials.union(trials), values((1, 1.0), (2, 2.0)), ["trial"]).orderBy("trial").collect()


def test_looked_up(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "kind string, id int")
    pool = spark.createDataFrame([("a", 1.0), ("c", None)], "kind string, level double")
    assert sorted(map(tuple, alignment.looked_up(df.where("kind = 'a'"), pool, ["kind"]).collect())) == [("a", 1, 1.0), ("a", 3, 1.0)]
    assert [tuple(x) for x in alignment.missing_keys(df, pool, ["kind"]).collect()] == [("b", 1)]
    with pytest.raises(Exception, match="missing level for b"):
        alignment.looked_up(df, pool, ["kind"], "level").select("level").collect()
    with pytest.raises(Exception, match="missing level for null"):
        alignment.looked_up(df.select(F.lit(None).cast("string").alias("kind")), pool, ["kind"], "level").collect()


def test_dataset_is_read_by_partition_and_whole(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"p{k % 3}", [float(k)]) for k in range(9)], "idx int, pattern string, image array<double>")
    path = dataset.save_dataset(rows, str(tmp_path), "set", Config())
    some, settings, _ = dataset.load_dataset(spark, path, ["p1"])
    assert sorted(x["idx"] for x in some.collect()) == [1, 4, 7] and settings["seed"] == Config().seed
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pattern" in plan
    assert all("pattern=p1" in f for f in some.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    assert sorted(map(tuple, dataset.counts(spark, path).collect())) == [("p0", 3), ("p1", 3), ("p2", 3)]
    with pytest.raises(ValueError, match="no pattern p9"):
        dataset.load_dataset(spark, path, ["p1", "p9"])
    broken = rows.withColumn("image", F.when(F.col("idx") == 5, F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("image")))
    with pytest.raises(Exception, match="lost"):
        dataset.save_dataset(broken, str(tmp_path), "set", Config())
    assert dataset.datasets(spark, str(tmp_path), "set") == [path] and dataset.datasets(spark, f"{tmp_path}/none") == []
    half = next(str(p) for p in tmp_path.iterdir() if str(p) != path)
    with pytest.raises(ValueError, match="no whole dataset"):
        dataset.load_dataset(spark, half)


def test_two_datasets_of_one_second(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p", [1.0])], "idx int, pattern string, image array<double>")
    assert len({dataset.save_dataset(rows, str(tmp_path), "set", Config()) for _ in range(2)}) == 2
    assert len(dataset.datasets(spark, str(tmp_path))) == 2
    assert json.loads(json.dumps(Config().settings()))


def test_metrics_of_tasks(spark):
    df = spark.createDataFrame([(k, k % 5, [float(k), 1.0]) for k in range(200)], "trial int, label int, signal array<double>").repartition(6)
    d = Diagnostics(enabled=True)
    cells = images.erp_image(df, ["label", "trial"], 8, 4, rate=F.lit(50.0), diagnostics=d)
    assert cells.count() == 32 and cells.count() == 32  # reading again counts nothing
    calls = {r["name"]: (r["count"], r["time"]) for r in totals(d.calls(spark)).where("all_workers").collect()}
    assert {n: c for n, (c, _) in calls.items()} == {"erpimage_sorted": 150, "resize_img": 32} and all(t > 0 for _, t in calls.values())
    d.reset()
    assert d.calls(spark).collect() == []
    off = Diagnostics()
    assert sorted(map(tuple, images.erp_image(df, ["label", "trial"], 8, 4, rate=F.lit(50.0), diagnostics=off).collect())) == sorted(map(tuple, cells.collect()))
    assert off.calls(spark).collect() == [] and off.step("x", df) is df


def totals_by_hand(points, spans):
    """{span: (points, least point, sum)} of rows (point, place, value) and (span, opens, closes)."""
    held = {i: [(k, v) for k, at, v in points if at is not None and a <= at <= b] for i, a, b in spans if a is not None and b is not None}
    return {i: (len(x), min(k for k, _ in x), sum(v for _, v in x if v is not None) if any(v is not None for _, v in x) else None) for i, x in held.items() if x}


@pytest.mark.parametrize("hot,places", [(1, 40), (7, 5000), (200_000, 5000), (200_000, 3)])
def test_interval_totals(spark, hot, places):
    r = random.Random(places)
    points = [(k, r.choice([None, 1 << 40, *[r.randrange(-places, places) for _ in range(8)]]), r.choice([None, 0.25, 1.5, -2.0])) for k in range(600)]
    spans = [(k, s := r.randrange(-places, places), s + r.choice([-1, 0, 1, 2, 63, 64, places, 1 << 41])) for k in range(150)]
    spans += [(200 + k, -places, places) for k in range(30)] + [(300 + k, -places, k) for k in range(30)] + [(90_000, None, 5), (90_001, 5, None)]
    p = spark.createDataFrame(points, "point int, place long, value double").repartition(3)
    s = spark.createDataFrame(spans, "span int, opens long, closes long").repartition(2)
    got = intervals.interval_totals(p, s, "place", "opens", "closes", {"n": ("count", "place"), "least": ("min", "point"), "total": ("sum", "value")}, hot)
    assert got.columns == ["span", "opens", "closes", "n", "least", "total"]
    rows = got.collect()
    assert {x["span"]: (x["n"], x["least"], x["total"]) for x in rows} == totals_by_hand(points, spans) and len(rows) == len({x["span"] for x in rows})


def test_interval_totals_of_nothing_and_of_odd_values(spark):
    p = spark.createDataFrame([(1, 5, float("nan")), (2, 7, float("inf")), (3, 9, 1.0)], "point int, place long, value double")
    s = spark.createDataFrame([(1, 0, 4), (2, 5, 5), (3, 6, 8), (4, 8, 10)], "span int, opens long, closes long")
    total = lambda p, s: {x["span"]: str(x["total"]) for x in intervals.interval_totals(p, s, "place", "opens", "closes", {"total": ("sum", "value")}).collect()}
    assert total(p.limit(0), s) == total(p, s.limit(0)) == {}
    assert total(p, s) == {2: "nan", 3: "inf", 4: "1.0"}


def most_rows(node):
    """The most rows that a step of an executed plan gave."""
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.executedPlan()
    if "QueryStage" in node.nodeName():
        return most_rows(node.plan())
    out, below = node.metrics().get("numOutputRows"), node.children()
    return max([out.get().value() if out.isDefined() else 0, *[most_rows(below.apply(k)) for k in range(below.size())]])


def test_query_of_all_intervals_makes_no_pairs(spark, tmp_path):
    """3,000 windows that hold 4.5 million pairs, all events being within the shortest window."""
    rows = spark.range(3000).selectExpr("id AS event_id", "timestampadd(MICROSECOND, id * 1000, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts", "id % 5 AS user_id", "'purchase' AS event_type", "CAST(id % 100 AS DOUBLE) AS value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    result = queries()["interval_join_all"](spark, str(tmp_path))
    got = {x["window_id"]: (x["n"], x["first_event"], x["total"]) for x in result.collect()}
    assert got == {k: (3000 - k, k, float(sum(i % 100 for i in range(k, 3000)))) for k in range(3000)}
    assert most_rows(result._jdf.queryExecution().executedPlan()) < 400_000
