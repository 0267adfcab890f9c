import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somaframe.config import BreathRules, WindowDef
from somaframe.functions import kernels as K
from somaframe.functions import names as N
from somaframe.functions.pieces import Pieces
from somaframe.operators import beats as B
from somaframe.operators import cleaning as C
from somaframe.operators import ecg as E
from somaframe.operators import frequency as Q
from somaframe.operators import ingest as I
from somaframe.operators import mixed_model as M
from somaframe.operators import respiration as R
from somaframe.operators import stats as D
from somaframe.operators import tables as T
from somaframe.operators import windows as W
from somaframe.sources import files


def series(spark, rr, subject="a", shuffled=False):
    t, rows = 0.0, []
    for i, v in enumerate(rr):
        t += (v or 800) / 1000
        rows.append((subject, i, t, None if v is None else float(v)))
    if shuffled:
        random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "subject_id string, seq long, t_s double, rr_ms double")


def values(df):
    return [r.rr_ms for r in df.orderBy("t_s", "seq").collect()]


def test_names(spark):
    known = {
        "sub-P002_ses-S001_task-Default_run-001_all_rr_h10": ("P002S001T001R001", "rr"), "f1o01_ecg": ("f1o01", "ecg"),
        "p003s001t002r001_hr": ("P003S001T002R001", "hr"), "rec42_resp": ("P042S001T001R001", "resp"), "notes": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in known], "name string")
    found = {r.name: (r.sid, r.signal) for r in df.select("name", N.infer_subject(F.col("name")).alias("sid"), N.detect_signal(F.col("name")).alias("signal")).collect()}
    assert found == known


@pytest.mark.parametrize(("times", "divisor"), [([0.0, 0.5, 1.0], 1), ([0.0, 20.0, 40.0, 60.0], 1000), ([7e5, 7.1e5, 7.2e5 - 1], 1), ([0.0, 2e5, 4e5], 1e6), ([0.0, 50.0], 1)])
def test_time_units(spark, times, divisor):
    df = spark.createDataFrame([("a", t) for t in times], "subject_id string, time double")
    assert sorted(r.time for r in I.in_seconds(df, ["subject_id"]).collect()) == pytest.approx([t / divisor for t in times])


def test_order_of_rows_does_not_matter(spark):
    rr = [800, 820, 1640, 790, 400, 810, 805, 2400, 795] * 4
    assert values(C.cleaned(series(spark, rr))) == pytest.approx(values(C.cleaned(series(spark, rr, shuffled=True))))


def test_split_keeps_the_time(spark):
    rr = [800.0] * 8 + [1600.0] + [800.0] * 8
    out = C.split_multiples(series(spark, rr))
    assert values(out) == pytest.approx([800.0] * 18)
    assert out.agg(F.max("t_s")).first()[0] == pytest.approx(sum(rr) / 1000)


def test_long_runs_stay(spark):
    rr = [800.0] * 12 + [450.0] * 11 + [800.0] * 12
    kept = [r.run for r in C.with_runs(series(spark, rr)).where("rr_ms = 450").collect()]
    assert kept == [None] * 11


def test_cubic_fill_is_the_kernel(spark):
    rng = np.random.default_rng(3)
    rr = rng.uniform(700, 900, 40)
    df = series(spark, rr.tolist()).withColumn("bad", F.col("seq").isin(0, 7, 8, 20, 39))
    rows = df.orderBy("t_s").toPandas()
    good = ~rows.bad.to_numpy()
    want = K.monotone_cubic(rows.t_s[good].to_numpy(), rows.rr_ms[good].to_numpy(), rows.t_s.to_numpy())
    got = np.array(values(C.cubic_fill(df)))
    inner = ~np.isnan(want)
    assert got[inner] == pytest.approx(want[inner])
    assert got[0] == got[1] and got[-1] == got[-2]


def test_nulls_and_empty(spark):
    empty = series(spark, [800.0]).limit(0)
    for f in (C.cleaned, C.cleaned_ecg, C.runs, C.quality, B.flags):
        assert f(empty).count() == 0
    assert values(C.linear_fill(series(spark, [800.0, None, 820.0]).withColumn("bad", F.col("rr_ms").isNull())))[1] == pytest.approx(810, abs=1)


def test_windows(spark):
    spans = spark.createDataFrame([("a", 0.0, 10.0)], "subject_id string, t0 double, t1 double")
    assert W.sliding(spans, 2, 1).count() == 3
    assert W.sliding(spans, 2, -1).count() == 9
    with pytest.raises(ValueError, match="step"):
        W.sliding(spans, 2, -2)
    with pytest.raises(ValueError, match="either"):
        W.single(spans, 0)
    top = W.numbered(W.sliding(spans, 5))
    both = W.collected([top, W.subdivided(top, 1, 1, 2.5)])
    leaf = W.leaves(both).orderBy("final_order").collect()
    assert [(r.level, r.w_id) for r in leaf] == [(2, 1), (2, 2), (1, 2)]
    assert sum(r.duration_s for r in leaf) == 10
    marks = spark.createDataFrame([("a", 0, 1.0, "x "), ("a", 1, 5.0, "y"), ("a", 2, 9.0, "x")], "subject_id string, seq int, time_s double, label string")
    got = W.labelled(marks, [WindowDef("p", "x", "y", 0.5)]).collect()
    assert [(r.t_start_s, r.t_end_s) for r in got] == [(1.5, 4.5)]


def test_bucketed_slices_are_the_same(spark):
    beats = series(spark, [800.0] * 200)
    cut = W.numbered(W.sliding(W.bounds(beats), 7.3, -2))
    plain, dealt = (W.sliced(beats, cut, bucket=b).select("seq", "w_id").collect() for b in (None, 5.0))
    assert sorted(plain) == sorted(dealt)
    assert plain


def test_spectrum_finds_the_breath(spark):
    n = np.arange(1000)
    rows = [("a", 1, int(i), float(np.sin(2 * np.pi * 0.25 * i / 4))) for i in n]
    grid = spark.createDataFrame(rows, "subject_id string, w_id int, n long, x double")
    density = Q.spectrum(grid, line=False).orderBy("k").toPandas()
    hz, power = K.spectrum(np.array([r[3] for r in rows]), 4, 256)
    assert density.power.to_numpy() == pytest.approx(power[: len(density)], abs=1e-9)
    assert density.hz.to_numpy() == pytest.approx(hz[: len(density)])


RULES = BreathRules(rate=10.0)


def breathing(spark, wave, holes=()):
    rows = [("a", 1, i, i / 10, None if i in holes else float(v)) for i, v in enumerate(wave)]
    return spark.createDataFrame(rows, "subject_id string, w_id int, seq int, time_s double, value double")


@pytest.mark.parametrize(("wave", "status"), [(500 + 100 * np.sin(2 * np.pi * 0.25 * np.arange(900) / 10), "ok"), (np.full(900, 500.0), "reject"), (500 + 100 * np.sin(2 * np.pi * 0.25 * np.arange(50) / 10), "reject")])
def test_respiration_status(spark, wave, status):
    rows = R.report(R.cleaned(breathing(spark, wave), rules=RULES)).collect()
    assert [r.status for r in rows] == [status]
    if status == "ok":
        assert rows[0].bpm == pytest.approx(15, rel=0.05)


def test_respiration_collapse_is_trimmed(spark):
    wave = 500 + 100 * np.sin(2 * np.pi * 0.25 * np.arange(1200) / 10)
    wave[500:700] = 500
    got = R.report(R.cleaned(breathing(spark, wave), rules=RULES)).first()
    assert got.status == "partial"
    assert len(got.kept_spans) == 2


def test_breaths_and_rsa(spark):
    wave = np.sin(2 * np.pi * 0.25 * np.arange(1200) / 10)
    peaks = R.breath_peaks(breathing(spark, wave), rules=RULES)
    assert 28 <= peaks.count() <= 30
    beats = spark.createDataFrame([("a", 1, i, i * 0.5, 800.0 + 50 * math.sin(2 * math.pi * 0.25 * i * 0.5)) for i in range(240)], "subject_id string, w_id int, seq int, t_s double, rr_ms double")
    got = R.sinus_arrhythmia(R.breaths(peaks), beats, breathing(spark, wave)).first()
    assert got.resp_rate_bpm == pytest.approx(15, rel=0.01)
    assert got.rsa_ms == pytest.approx(100, rel=0.05)
    assert got.resp_amp == pytest.approx(2, rel=0.05)


def test_plateaus():
    t = np.arange(100) / 10
    v = np.clip(np.sin(2 * np.pi * t / 5), -1, 0.5) * 100 + 200
    out = R.canonical_plateaus(t, v, BreathRules(plateau_reach=2.0))
    tops = np.flatnonzero(out == out.max())
    assert len(tops) == 2


def test_long_ecg_in_chunks(spark):
    """Chunks see enough of their neighbours: the beats of a recording are those of one chunk, breaks and repeated samples included."""
    rng = np.random.default_rng(4)
    beat = np.cumsum(rng.normal(0.8, 0.05, 330))
    t = np.arange(0, 260, 0.01)
    v = sum(np.exp(-0.5 * ((t - b) / 0.015) ** 2) for b in beat) + 0.3 * np.sin(2 * np.pi * 0.25 * t) + rng.normal(0, 0.02, len(t))
    some = (t < 95.5) | (t > 131)
    wave = pd.DataFrame({"subject_id": "a", "time_s": t[some], "value": v[some]})
    ecg = spark.createDataFrame(pd.concat([wave, wave.iloc[500:520]]))
    one, many = (E.to_beats(ecg, chunk=c).orderBy("seq").toPandas() for c in (1e6, 40.0))
    assert many.t_s.between(39, 200).sum() > 100 and many.rr_ms.max() < 1100
    assert many.t_s.tolist() == one.t_s.tolist() and many.rr_ms.tolist() == pytest.approx(one.rr_ms.tolist())
    assert E.peaks(ecg, chunk=40.0).count() == len(beat[(beat < 95.5) | ((beat > 131) & (beat < 260))])


def test_ecg_spikes_come_back(spark):
    at = np.cumsum(np.tile([80, 90, 85], 20))
    v = np.zeros(at[-1] + 60)
    v[at] = 1.0
    ecg = spark.createDataFrame([("a", i / 100, float(x)) for i, x in enumerate(v)], "subject_id string, time_s double, value double")
    got = [r.rr_ms for r in E.to_beats(ecg).orderBy("t_s").collect()]
    assert got == pytest.approx((np.diff(at) * 10).tolist())
    with_gap = ecg.where("time_s < 10 OR time_s > 20")
    assert E.to_beats(with_gap).agg(F.max("rr_ms")).first()[0] < 1000


def test_mixed_model_is_the_likelihood(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(40):
        u = rng.normal(0, 1.5)
        rows += [(s, s % 2, t, float(2 + t * (s % 2) + u + rng.normal())) for t in (1, 2, 3) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "subject_id long, task int, t_id int, y double")
    fit = M.fit(df, "y")
    cells = fit.cells

    def loglik(beta, between, residual):
        total = 0.0
        for s in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == s]
            d = np.array([r[3] - beta[cells.index((r[1], r[2]))] for r in own])
            v = residual * np.eye(len(own)) + between
            total -= 0.5 * (len(own) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + d @ np.linalg.solve(v, d))
        return total

    best = loglik(fit.means, fit.between, fit.residual)
    assert best == pytest.approx(fit.loglik)
    for k in range(30):
        r = np.random.default_rng(k)
        assert loglik(fit.means + r.normal(0, 0.05, len(cells)), fit.between * r.uniform(0.8, 1.25), fit.residual * r.uniform(0.8, 1.25)) <= best
    names, _ = fit.treatment()
    assert len(names) == 6
    assert set(fit.wald().term) == {"condition", "time", "condition:time"}
    assert len(fit.marginal("time")[1]) == 3 and len(fit.simple("time")) == 6


def test_repeated_keys_are_an_error(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 2.0)], "k int, w double")
    with pytest.raises(Exception, match="repeated k"):
        T.joined_once(a, b, "k").collect()


def test_files(spark, tmp_path):
    (tmp_path / "p001s001t001r001_rr.csv").write_text("t;rr\n1;800\n2;bad\n3;0.81\n4;820\n")
    (tmp_path / "notes.txt").write_text("x")
    df = files.read_csv(spark, str(tmp_path / "p001s001t001r001_rr.csv")).withColumn("subject_id", F.lit("a"))
    assert df.columns == ["t", "rr", "subject_id"]
    got = I.standard(df, "rr").orderBy("t_s").collect()
    assert [r.rr_ms for r in got] == [800, 810, 820]
    listed = {r.name: (r.subject_id, r.signal, r.status) for r in files.load("local", spark, folder=str(tmp_path)).collect()}
    assert listed == {"p001s001t001r001_rr": ("P001S001T001R001", "rr", "found"), "notes": (None, None, "skip")}
    assert files.read_table(spark, str(tmp_path / "none.parquet")) is None
    assert files.separator("a b c") == " "
    with pytest.raises(ValueError, match="unknown loader"):
        files.load("other", spark)


def test_records(spark, tmp_path):
    spark.createDataFrame([("f1", i, float(i), -float(i)) for i in range(5)], "name string, i int, ECG1 double, resp double").write.parquet(str(tmp_path / "r"))
    got = files.load("records", spark, folder=str(tmp_path / "r"), rate=250.0)
    assert got.count() == 10
    assert got.agg(F.max("time_s")).first()[0] == pytest.approx(4 / 250)


def test_breathing_rates_in_pieces(spark):
    """Pieces of 40 seconds give what one piece of all gives; a hole, and breaths that slow down."""
    t = np.arange(0, 900, 0.1)
    phase = 2 * np.pi * np.cumsum(0.25 + 0.05 * np.sin(t / 70)) / 10
    rows = [(1, float(x), float(100 * np.sin(p) + 8 * np.sin(7 * p))) for x, p in zip(t, phase, strict=True) if not 300 < x < 330] + [(2, float(x), 5.0) for x in t[:40]]
    df = spark.createDataFrame(rows, "subject_id int, time_s double, value double").withColumn("seq", F.col("time_s"))
    whole = R.rate_series(df, pieces=Pieces(10**6, 10**6), reach=300).orderBy("t").collect()
    assert len(whole) > 180 and all(10 < r.bpm < 20 for r in whole if not 295 < r.t < 335)
    for pieces in (Pieces(200, 30.0), Pieces(317, 1000.0)):
        assert R.rate_series(df, pieces=pieces, reach=150).orderBy("t").collect() == whole


def test_even_grid_is_interpolation(spark):
    """np.interp on the grid, with samples at one time, a break that is filled in blocks, and rates at both bounds."""
    rng = np.random.default_rng(4)
    rows = []
    for subject, step, n in (("fast", 1e-5, 400), ("slow", 0.5, 60), ("usual", 0.007, 500)):
        t = np.round(np.cumsum(rng.choice([step, step, 2 * step], n)), 6)
        t[n // 2 :] += 40.0 if subject == "usual" else 0.0
        rows += [(subject, float(x), float(v)) for x, v in zip(t, rng.normal(size=n), strict=True)]
    rows += [("few", float(i), 1.0) for i in range(4)] + [("usual", None, 1.0), ("usual", 1.0, None)]
    df = spark.createDataFrame(rows, "subject_id string, time_s double, value double")
    for pieces in (None, Pieces(50, 0.5)):
        got = E.resampled(df, pieces=pieces).toPandas()
        assert set(got.subject_id) == {"fast", "slow", "usual"}
        for subject, own in got.groupby("subject_id"):
            t, v = (np.array(c) for c in zip(*sorted((x, y) for s, x, y in rows if s == subject and x is not None and y is not None), strict=True))
            rate = min(2000.0, max(50.0, np.round(1 / np.median(np.diff(t)))))
            own = own.sort_values("n")
            grid = t[0] + np.arange(np.ceil((t[-1] - t[0]) * rate)) / rate
            assert own.fs_hz.unique().tolist() == [rate] and np.allclose(own.time_s, grid, atol=1e-9)
            assert np.allclose(own.value, np.interp(grid, t, v), atol=1e-7)


def test_quick_beats(spark):
    """Spikes in samples 4 to 12 ms apart come back at their times; two peaks are too few."""
    rng = np.random.default_rng(6)
    t = np.cumsum(rng.choice([0.004, 0.008, 0.012], 2500))
    value = sum(np.exp(-(((t - 0.5 - 0.8 * k) / 0.015) ** 2)) for k in range(24))
    rows = [(1, float(x), float(v)) for x, v in zip(t, value, strict=True)] + [(2, float(x), float(v)) for x, v in zip(t, value, strict=True) if x < 1.8]
    got = E.quick_beats(spark.createDataFrame(rows, "subject_id int, time_s double, value double")).toPandas()
    assert set(got.subject_id) == {1}
    assert len(got) == 23 and (abs(got.rr_ms - 800) <= 17).all() and abs(got.t_s.iloc[0] - 1.3) < 0.02


def many_sizes(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(60):
        u = rng.normal(0, 1.5)
        for k in range(2 + s % 23):
            c, t = s % 2, int(rng.integers(1, 4))
            rows.append((f"s{s}", c, t, float(2 + t * c + u + rng.normal()), None if k % 3 == 0 else float(5 - t + rng.normal()), float(rng.normal() * 1e-3 + s)))
    return spark.createDataFrame(rows, "subject_id string, task int, t_id int, y double, z double, w double")


def test_many_variables_in_one_aggregation(spark):
    df = many_sizes(spark)
    together = M.fits(df, ["y", "z", "w"])
    for v in ("y", "z", "w"):
        alone = M.fit(df.where(F.col(v).isNotNull()), v)
        assert together[v].cells == alone.cells and together[v].loglik == pytest.approx(alone.loglik)
        assert together[v].means == pytest.approx(alone.means) and together[v].n_obs == df.where(F.col(v).isNotNull()).count()


def test_sums_over_sizes_in_spark(spark):
    """With a bound that no table meets, ratios are searched by aggregations: the same fits."""
    df = many_sizes(spark)
    here, there = M.fits(df, ["y", "z"]), M.fits(df, ["y", "z"], most=20)
    for v in ("y", "z"):
        assert there[v].loglik == pytest.approx(here[v].loglik, abs=1e-9)
        assert there[v].means == pytest.approx(here[v].means, rel=1e-6) and there[v].covariance == pytest.approx(here[v].covariance, rel=1e-5)
        assert (there[v].between, there[v].residual) == pytest.approx((here[v].between, here[v].residual), rel=1e-5, abs=1e-9)
        assert (there[v].n_obs, there[v].n_groups) == (here[v].n_obs, here[v].n_groups)


def test_few_large_groups_are_not_shuffled(spark):
    """Rows of three groups stay where they are when each gets its group's fit."""
    rows = spark.range(90).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"), F.col("id").cast("double").alias("y"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = D.adjusted(rows, "y", "x", "z", ["g"])
        assert found.count() == 90
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mixed_model_by_arrow(spark):
    """How the session hands tables to the driver changes nothing."""
    rows = spark.range(60).select((F.col("id") % 20).alias("subject_id"), (F.col("id") % 2).cast("int").alias("task"), F.floor(F.col("id") / 20).alias("t_id"), (F.col("id") * 37 % 11).cast("double").alias("y"))
    plain = M.fit(rows, "y")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    try:
        by_arrow = M.fit(rows, "y")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.pyspark.enabled")
    assert by_arrow.cells == plain.cells and len(plain.cells) == 6
    assert by_arrow.loglik == pytest.approx(plain.loglik, rel=1e-12)
