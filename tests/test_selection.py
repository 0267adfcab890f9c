import numpy as np
import pytest
from pyspark.sql import functions as F

from somaframe.functions.selection import percentiles


@pytest.fixture(scope="module")
def groups(spark):
    """One value a half of all rows, outliers, one and two rows, negative and equal values, infinities, nulls, and a null key."""
    rng = np.random.default_rng(12)
    rows = [("hot", float(v)) for v in np.round(rng.normal(size=4000), 3)] + [("hot", 0.25)] * 4000 + [("hot", 1e12), ("hot", -1e12)]
    rows += [("narrow", 1e6 + float(v) * 1e-6) for v in rng.random(3000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("same", 3.0), ("same", 3.0), ("same", 3.0)]
    rows += [("inf", float("inf")), ("inf", 1.0), ("inf", float("-inf")), (None, 1.0), (None, 4.0), ("nulls", None), ("hot", None)] + [("small", float(v)) for v in range(11)]
    return spark.createDataFrame(rows, "g string, v double").repartition(4)


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_same_as_percentile(groups, accuracy):
    """With sketches so coarse, too, that brackets hold many values."""
    shares = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
    names = [f"p{i}" for i in range(len(shares))]
    want = {r.g: tuple(r)[1:] for r in groups.where("v IS NOT NULL").groupBy("g").agg(*(F.percentile("v", F.lit(s)).alias(n) for s, n in zip(shares, names, strict=True))).collect()}
    got = {r.g: tuple(r)[1:] for r in percentiles(groups, "v", shares, names, ["g"], accuracy).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12, nan_ok=True), g


def test_over_all_rows(groups):
    want = groups.where("v IS NOT NULL").agg(F.percentile("v", F.lit(0.3))).first()[0]
    assert percentiles(groups, "v", [0.3], ["p"]).first().p == want
    assert percentiles(groups.where("v IS NULL"), "v", [0.3], ["p"]).collect()[0].p is None


def test_few_rows_are_ranked(spark):
    """Of a million values of one group, only those near the rank are ordered."""
    rows = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).alias("g"), F.xxhash64("id").cast("double").alias("v"))
    found = percentiles(rows, "v", [0.5], ["p"], ["g"])
    assert found.first().p == rows.agg(F.percentile("v", F.lit(0.5))).first()[0]
