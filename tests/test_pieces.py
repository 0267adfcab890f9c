import numpy as np
import pytest
from pyspark.sql import functions as F

from somaframe.functions.pieces import Pieces, done
from somaframe.operators import cleaning as C
from somaframe.operators import ecg
from somaframe.operators import respiration as R

KEY = ["subject_id", "t_s", "seq"]


@pytest.fixture(scope="module")
def hot(spark):
    """One subject with most of the beats, with bursts, breaks, ties, nulls, long and short bad runs, and runs over the borders of pieces."""
    rng = np.random.default_rng(8)
    rows = []
    for subject, n in (("hot", 1500), ("a", 260), ("b", 49), ("c", 1), ("d", 51), (None, 120)):
        t = np.cumsum(np.where(rng.random(n) < 0.01, 4000.0, rng.choice([0.0, 0.8, 1.1, 2.5], n)))
        rr = 800 + rng.normal(size=n) * 20
        at = 0
        while at < n:
            size = int(rng.choice([1, 2, 5, 9, 10, 11, 12, 30]))
            if rng.random() < 0.35:
                rr[at : at + size] = rng.choice([300.0, 1700.0, 2400.0, 1300.0])
            at += size + int(rng.integers(1, 40))
        for i in range(n):
            rows.append((subject, i, None if rng.random() < 0.01 else float(t[i]), None if rng.random() < 0.02 else float(rr[i])))
    return spark.createDataFrame(rows, "subject_id string, seq long, t_s double, rr_ms double").repartition(5)


def same(a, b, keys=KEY):
    assert sorted(a.columns) == sorted(b.columns)
    x, y = (d.select(*sorted(d.columns)).toPandas() for d in (a, b))
    order = [*keys, *(c for c in sorted(x.columns) if c not in keys)]
    x, y = (d.sort_values(order, na_position="first").reset_index(drop=True) for d in (x, y))
    assert len(x) == len(y) > 0
    for c in x.columns:
        if x[c].dtype == float:
            assert np.allclose(x[c], y[c], equal_nan=True, rtol=1e-12), c
        else:
            assert (x[c].fillna(-9) == y[c].fillna(-9)).all(), c


PIECES = [Pieces(50, 60.0), Pieces(17, 5.0), Pieces(100_000, 1e9)]


@pytest.mark.parametrize("pieces", PIECES)
def test_places(hot, pieces):
    """_rank is the row number of one window over the whole subject."""
    from pyspark.sql import Window

    want = hot.withColumn("n", F.row_number().over(Window.partitionBy("subject_id").orderBy("t_s", "seq")) - 1)
    got = pieces.ranked(hot).withColumn("n", F.col("_rank").cast("int"))
    assert got.where(F.col("_piece") != F.floor(F.col("_rank") / pieces.rows)).isEmpty()
    same(want, done(got))


@pytest.mark.parametrize("work", [C.medians, C.candidates, C.with_runs, C.split_multiples, C.dropped, C.weighted_fill, C.ecg_marks], ids=lambda f: f.__name__)
def test_same_in_pieces(hot, work):
    for pieces in (Pieces(50, 60.0), Pieces(17, 5.0)):
        same(work(hot), work(hot, pieces=pieces))


def test_runs_over_borders(hot):
    same(C.runs(hot), C.runs(hot, pieces=Pieces(50, 60.0)), ["subject_id", "run"])
    assert C.with_runs(hot).where("run IS NOT NULL").select("subject_id", "run").distinct().count() > 20


@pytest.mark.parametrize("fill", [C.linear_fill, C.cubic_fill], ids=lambda f: f.__name__)
def test_fills(hot, fill):
    """Marks of any length, so that good neighbours lie whole pieces away."""
    rows = hot.where("t_s IS NOT NULL").dropDuplicates(["subject_id", "t_s"]).withColumn("bad", (F.pmod(F.col("seq"), F.lit(300)) < 170) | (F.col("seq") % 7 == 0)).cache()
    same(fill(rows), fill(rows, pieces=Pieces(50, 60.0)))


def test_smoothing_and_chain(hot):
    rows = hot.where("t_s IS NOT NULL").dropDuplicates(["subject_id", "t_s"]).withColumn("near", F.col("seq") % 11 < 3)
    same(C.smoothed_near(rows), C.smoothed_near(rows, pieces=Pieces(17, 5.0)))
    beats = rows.drop("near")
    for methods in (("split", "interp"), ("delete",), ("fill",)):
        same(C.cleaned(beats, methods), C.cleaned(beats, methods, pieces=Pieces(60, 100.0)))


def test_a_hot_subject_is_spread(hot):
    """Of windows over pieces, no task holds more than a piece with its borders; all shuffles but those over pieces' sums are by cell or piece."""
    found = Pieces(50, 60.0).around(hot, 5, lambda rows, order: rows.withColumn("m", C.rolling_median("rr_ms", 11, order)))
    sizes = Pieces(50, 60.0).bordered(Pieces(50, 60.0).ranked(hot), 5).groupBy("subject_id", "_at").count()
    assert sizes.agg(F.max("count")).first()[0] <= 60
    assert sizes.where("subject_id = 'hot' AND _at < 30").count() == 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line and "medi" in line or "Window" in line and "percentile" in line]
    assert windows and all("_at#" in line for line in windows)


def test_reach_must_fit(hot):
    with pytest.raises(ValueError):
        Pieces(10, 60.0).bordered(Pieces(10, 60.0).ranked(hot), 11)


def test_breathing_rates_read_their_input_once(spark):
    """However often its results are needed, a recording is thinned once."""
    read = spark.sparkContext.accumulator(0)

    def seen(value):
        read.add(1)
        return value

    wave = spark.range(600).select(F.lit(1).alias("subject_id"), (F.col("id") / 10).alias("time_s"), F.sin(F.col("id") / 6).alias("value"))
    rows = wave.withColumn("value", F.udf(seen, "double").asNondeterministic()("value"))
    assert R.rate_series(rows).count() > 5
    assert read.value == 600


@pytest.mark.parametrize("mirrored", [False, True])
def test_a_peak_beside_a_long_flat_stretch_stands_out_in_pieces_too(spark, mirrored):
    """Half a minute without breath, longer than a piece sees of its neighbour: how deep the breaths are on its other side is known there only."""
    i = np.arange(1200)
    depth = np.where((i >= 450) & (i < 600), 0.0, np.where((i >= 600) & (i < 630), 60.0, 250.0))
    wave = 512 + depth * np.sin(2 * np.pi * i / 30)
    if mirrored:
        wave = wave[::-1]
    rows = [(s, k, k / 5, float(v)) for s in (1, 2) for k, v in enumerate(wave)]
    df = spark.createDataFrame(rows, "subject_id long, seq int, time_s double, value double")
    ordered = lambda found: found.orderBy("subject_id", "t").collect()
    whole = ordered(R.rate_series(df, pieces=Pieces(10**6, 10**6), reach=300))
    assert ordered(R.rate_series(df, pieces=Pieces(600, 60.0), reach=100)) == whole
    assert ordered(R.rate_series(df, pieces=Pieces(100, 20.0), reach=40)) == whole


def test_no_chunk_beside_a_recording(spark):
    """Samples near the border of a chunk that the recording does not reach are not dealt, filtered and searched twice."""
    rows = [("short", i / 10, float(i)) for i in range(100)] + [("long", i / 10, float(i)) for i in range(500)]
    ends = F.when(F.col("subject_id") == "long", 2).otherwise(0)
    df = spark.createDataFrame(rows, "subject_id string, time_s double, value double").withColumns({"_first": F.lit(0), "_last": ends})
    found = {(r.subject_id, r._c): r["count"] for r in ecg.chunked(df, 20.0, 5.0, ("_first", "_last")).groupBy("subject_id", "_c").count().collect()}
    assert found == {("short", 0): 100, ("long", 0): 250, ("long", 1): 300, ("long", 2): 150}


def test_rates_move_pieces_not_samples(spark):
    """A recording is thinned where it is, and moved as a row for each cell or piece: a few bytes a sample (before: over 50)."""
    from somaframe.functions.frames import spread

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        executors = sc.statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    subjects = spread(spark.range(8).select(F.col("id").alias("subject_id")), "subject_id")
    n = 40_000
    resp = subjects.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("time_s", F.col("seq") / 8)
    resp = resp.withColumn("value", F.round(500 + (60 + F.col("seq") % 97) * F.sin(F.col("seq") * (0.2 + F.col("subject_id") / 100))))
    before = shuffled()
    assert R.rate_series(resp, pieces=Pieces(600, 60.0), reach=100).count() > 1000
    assert shuffled() - before < 16 * 8 * n


def test_range_of_long_recordings(spark):
    """Recordings over the bound are counted in two passes, with the same percentiles; medians and means of five as windows have them."""
    rng = np.random.default_rng(5)
    whole = {k: rng.integers(0, 900, size).astype(float) for k, size in ((1, 7), (2, 3000), (None, 500), (4, 1))}
    rows = [(k, v[i : i + 200].tolist(), len(v[i : i + 200])) for k, v in whole.items() for i in range(0, len(v), 200)]
    series = spark.createDataFrame(rows, "subject_id long, v array<double>, _n long")
    told = [{r.subject_id: (r._lo, r._hi) for r in R._ranges_of(series, ["subject_id"], most=most).collect()} for most in (10**6, 400, 0)]
    assert told[0] == told[1] == told[2]
    assert told[0] == {k: pytest.approx(tuple(np.percentile(v, [1, 99])), rel=1e-12) for k, v in whole.items()}
    for v in (whole[1], whole[2][:40], whole[4], whole[2][:2]):
        five = [np.median(v[max(0, i - 2) : i + 3]) for i in range(len(v))]
        assert R._smooth(v, 5).tolist() == pytest.approx([np.mean(five[max(0, i - 2) : i + 3]) for i in range(len(v))])


def test_rates_of_sparse_recordings(spark):
    """Places with holes between them, cells that are empty, and keys that are null, in pieces and in one."""
    rng = np.random.default_rng(8)
    rows = []
    for k in (None, 5):
        t = np.sort(rng.choice(60_000, 9_000, replace=False)) / 10.0
        t = t[(t % 1000) < 600]
        rows += [(k, int(i), float(x), float(np.round(100 * np.sin(x)))) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "subject_id long, seq long, time_s double, value double")
    told = [sorted((r.subject_id or 0, r.t, r.bpm) for r in R.rate_series(df, pieces=p, reach=reach).collect()) for p, reach in ((Pieces(10**6, 10**6), 300), (Pieces(500, 30.0), 100))]
    assert told[0] == told[1] and len(told[0]) > 100
