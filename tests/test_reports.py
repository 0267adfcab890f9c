"""Windows are judged where their samples are: no shuffle of samples, and no cleaned samples for a report."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from somaframe.config import BreathRules
from somaframe.operators import respiration as R
from somaframe.plans import QUERIES

RULES = BreathRules(rate=10.0)
KEYS = ["subject_id"]


def windows(spark):
    """Whole, with holes, with gaps and steps back in time, flat, short, noisy, clipped, without any value."""
    rng = np.random.default_rng(4)
    i = np.arange(900)
    wave = 100 * np.sin(2 * np.pi * 0.25 * i / 10)
    shapes = {
        "whole": wave, "holes": np.where(i % 300 < 9, np.nan, wave), "noise": rng.normal(0, 100, 900), "flat": np.where((i > 300) & (i < 500), 3.0, wave),
        "shallow": wave / 50, "clipped": np.minimum(wave, 60.0), "none": np.full(900, np.nan), "gaps": wave, "back": wave, "short": wave[:40],
    }
    rows = []
    for name, values in shapes.items():
        t = np.arange(len(values)) / 10
        t = np.where(t >= 40, t + (5 if name == "gaps" else -8 if name == "back" else 0), t)
        rows += [(name, k, float(a), None if np.isnan(v) else float(v)) for k, (a, v) in enumerate(zip(t, values, strict=True))]
    rng.shuffle(rows)
    return spark.createDataFrame([(a, int(b), float(c), None if d is None else float(d)) for a, b, c, d in rows], "subject_id string, seq long, time_s double, value double")


def test_spans_as_split(spark):
    rows = R.split(windows(spark), KEYS, RULES).toPandas().sort_values(["subject_id", "seq"])
    for _, own in rows.groupby("subject_id"):
        assert np.array_equal(R._spans(own["time_s"].to_numpy(float), own["value"].to_numpy(float), RULES), own["span"].to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("policy", ["multi", "longest"])
def test_reports_as_of_cleaned_samples(spark, policy):
    rows = windows(spark).cache()
    want = R.report(R.cleaned(rows, KEYS, RULES, policy=policy), KEYS).orderBy("subject_id").collect()
    got = R.reports(rows, KEYS, RULES, policy=policy).orderBy("subject_id").collect()
    assert got == want and {r.status for r in got} == {"ok", "partial", "reject"}


def test_quantile_as_numpy():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 37):
        v = rng.normal(size=n)
        assert R._median(v) == np.median(v)
        assert [R._quantile(np.sort(v), q) for q in (0.05, 0.1, 0.9, 0.95)] == np.percentile(v, [5, 10, 90, 95]).tolist()


@pytest.mark.parametrize("name", ["breath_report", "resp_clean", "resp_clean_counts"])
def test_samples_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapGroupsIn"):]
    assert "Generate" in below and "Exchange" not in below[: below.index("Generate")]


def test_subjects_in_many_tasks(spark):
    from somaframe.sources import sample_views as V

    parts = V.resp(spark, "/root/testdata/sf0.01").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts == int(spark.conf.get("spark.sql.shuffle.partitions"))
