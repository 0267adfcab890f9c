"""Running totals meet borders exactly."""

import math

import numpy as np
from pyspark.sql import functions as F

from somaframe.config import SpectrumRules
from somaframe.functions.frames import in_time, running_total
from somaframe.operators import frequency as Q
from somaframe.operators import respiration as R


def test_total_of_tenths_is_whole(spark):
    rows = spark.createDataFrame([("a", i, float(i), 0.1) for i in range(10)], "subject_id string, seq long, t_s double, rr_ms double")
    got = [r.c for r in rows.withColumn("c", running_total("rr_ms", in_time())).orderBy("seq").collect()]
    assert got == [(i + 1) / 10 for i in range(10)]  # doubles add up to 0.30000000000000004 and 0.9999999999999999


def test_what_does_not_fit_is_summed_as_doubles(spark):
    values = [1.0, None, 1e15, 2.0, math.nan, 3.0]
    rows = spark.createDataFrame([("a", i, float(i), v) for i, v in enumerate(values)], "subject_id string, seq long, t_s double, rr_ms double")
    got = [r.c for r in rows.withColumn("c", running_total("rr_ms", in_time())).orderBy("seq").collect()]
    assert got[:4] == [1.0, 1.0, 1e15 + 1, 1e15 + 3] and math.isnan(got[4]) and math.isnan(got[5])


def test_beat_on_a_border_is_the_next_breath(spark):
    """The tenth beat ends at 6 s exactly, where the second breath begins; a sum of doubles has it at 5.999999999999999 s, in the first."""
    rr = [600.3, 600.2, 600.9, 600.2, 599.7, 599.7, 599.7, 599.9, 600.7, 598.7, 700.0, 800.0]
    rows = spark.createDataFrame([("a", i, float(i), v) for i, v in enumerate(rr)], "subject_id string, seq long, t_s double, rr_ms double")
    beats = rows.withColumn("t_s", running_total("rr_ms", in_time()) / 1000)
    breaths = spark.createDataFrame([("a", 1, 0.0, 6.0), ("a", 1, 6.0, 12.0)], "subject_id string, span int, t0 double, t1 double")
    got = {r.t0: r._n for r in R._ranges(breaths, beats, "t_s", "rr_ms", ["subject_id"], None).collect()}
    assert got == {0.0: 9, 6.0: 3}


def test_recording_that_ends_on_a_grid_point_ends_there(spark):
    """Its beats last 6.25 s exactly, 25 points at 4 Hz; a sum of doubles is 6.250000000000001 s, and a 26th point would change all of its spectrum."""
    rr = [826.9, 579.65, 715.6, 941.7, 933.6500000000001, 658.15, 816.05, 542.05, 1063.15]
    rows = spark.createDataFrame([("a", i, float(i), v) for i, v in enumerate(rr)], "subject_id string, seq long, t_s double, rr_ms double")
    assert sorted(r.n for r in Q.tachogram(rows, keys=["subject_id"]).collect()) == list(range(25))


def test_beats_too_long_for_decimals_are_laid_on_the_grid_all_the_same(spark):
    rows = spark.createDataFrame([("a", i, float(i), v) for i, v in enumerate([1000.0, 1000.0, 3000.0, 1e12, 2000.0])], "subject_id string, seq long, t_s double, rr_ms double")
    found = Q.tachogram(rows.where("seq < 3"), keys=["subject_id"], rules=SpectrumRules(least_points=1)).collect()
    assert sorted(r.n for r in found) == list(range(16))
    late = Q.tachogram(rows.withColumn("rr_ms", F.when(F.col("seq") == 3, 1e10).otherwise(F.col("rr_ms"))), keys=["subject_id"])
    assert late.agg(F.count("*")).first()[0] == 4 * (1 + 3 + 10**7 + 2)


def test_variation_of_eighths_is_the_nearest_double():
    """Nine periods of 6 s and one of 6.125 s vary by 0.0375 s exactly; from their mean it comes out as 0.0062499999999999995 of 6 s, which rounds down."""
    assert R._variation(np.array([6.0] * 9 + [6.125]), 6.0) == 0.00625
    v = np.random.default_rng(5).exponential(3, 200)
    assert math.isclose(R._variation(v, np.median(v)), v.std() / np.median(v), rel_tol=1e-12)
    assert R._variation(np.full(7, 0.1), 0.1) == 0.0
