import time

import numpy as np
from pyspark.sql import functions as F

from somaframe.functions.sweep import inside


def table(spark, seed=9):
    """Intervals that touch, that leave gaps and that reach over many cells; points at their ends, between them and before all; a hot subject; nulls."""
    rng = np.random.default_rng(seed)
    intervals, points = [], []
    for subject, n in (("hot", 400), ("a", 30), ("b", 1), (None, 5)):
        at = 0.0
        for i in range(n):
            at += float(rng.choice([0.0, 0.5, 7.0]))
            end = at + float(rng.choice([1.0, 3.0, 90.0]))
            intervals.append((subject, i // 10, at, end))
            points += [(subject, at, 1.0), (subject, end, 2.0), (subject, (at + end) / 2, None), (subject, at - 0.25, 3.0)]
            at = end
    points += [("none", 1.0, 1.0), ("hot", None, 1.0), ("hot", -5.0, 1.0)]
    return spark.createDataFrame(intervals, "subject_id string, span int, t0 double, t1 double"), spark.createDataFrame(points, "subject_id string, t double, v double")


def test_same_as_the_range_join(spark):
    intervals, points = table(spark)
    other = points.withColumnRenamed("subject_id", "s")
    want = intervals.join(other, (F.col("subject_id") == F.col("s")) & (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1"))).select("subject_id", "t", "v", "t0", "span", "t1")
    want = sorted(map(tuple, want.collect()), key=str)
    assert len(want) > 800
    for seconds in (None, 3.0, 50.0, 1e9):
        got = inside(intervals, points, "t", ["subject_id"], seconds).select("subject_id", "t", "v", "t0", "span", "t1")
        assert sorted(map(tuple, got.collect()), key=str) == want, seconds


def test_no_join_on_ranges(spark):
    intervals, points = table(spark)
    plan = inside(intervals, points, "t", ["subject_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    plan = inside(intervals, points, "t", ["subject_id"], 50.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_million_beats_of_one_subject(spark):
    """The time of ten times the rows is nowhere near a hundred times as long."""

    def run(n):
        beats = spark.range(n).select(F.lit(1).alias("subject_id"), (F.col("id") * 0.8).alias("t"))
        breaths = spark.range(n // 5).select(F.lit(1).alias("subject_id"), (F.col("id") * 4.0).alias("t0"), (F.col("id") * 4.0 + 3.5).alias("t1"))
        began = time.perf_counter()
        found = inside(breaths, beats, "t", ["subject_id"], 40_000.0).groupBy().agg(F.count("*"), F.count_distinct("t0")).first()
        assert found[1] == n // 5 and found[0] == n
        return time.perf_counter() - began

    run(10_000)
    assert run(1_000_000) < 25 * max(run(100_000), 0.4)
