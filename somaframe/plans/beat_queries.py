"""Queries of the beat, cleaning and time-domain operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaframe.functions.folders import checkpoint
from somaframe.functions.pieces import Pieces
from somaframe.operators import beats as B
from somaframe.operators import cleaning as C
from somaframe.operators import time_domain as T
from somaframe.operators import windows as W
from somaframe.plans.registry import ORACLES, query
from somaframe.plans.window_queries import DAY, SQL_DAYS, day_windows
from somaframe.sources import sample_views as V

WITH = f"WITH {V.SQL_BEATS}"
IN_TIME = "WINDOW w AS (PARTITION BY subject_id ORDER BY t_s, seq)"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- windows joined with beats, and features ---

SQL_CUT = f"""WITH {SQL_DAYS}, cut AS (SELECT b.*, w.w_id, w.t_start_s, w.t_end_s FROM beats b JOIN wins w ON b.subject_id = w.subject_id AND t_s >= t_start_s AND t_s < t_end_s),
    d AS (SELECT *, rr_ms - lag(rr_ms) OVER w AS d, t_s - lag(t_s) OVER w AS gap FROM cut WINDOW w AS (PARTITION BY subject_id, w_id ORDER BY t_s, seq))"""
SQL_TIME = {
    "hr_bpm": "60000 / avg(rr_ms)", "rmssd_ms": "sqrt(avg(d * d))", "sdnn_ms": "stddev_samp(rr_ms)", "pnn50_pct": "100 * avg(CASE WHEN abs(d) > 50 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0.0::DOUBLE END)",
    "sd1_ms": "sqrt(greatest(0, var_samp(d) / 2))", "sd2_ms": "sqrt(greatest(0, 2 * var_samp(rr_ms) - var_samp(d) / 2))",
}


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sliced(V.beats(spark, sf_dir), day_windows(spark, sf_dir), bucket=5 * DAY)


def sql_features(*names: str) -> str:
    return f"{SQL_CUT} SELECT subject_id, w_id, {', '.join(f'round({SQL_TIME[n]}, 6) AS {n}' for n in names)} FROM d GROUP BY 1, 2"


def features(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return rounded(T.features(cut(spark, sf_dir), names), *names)


@query(sql_features(*SQL_TIME))
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir, *T.FEATURES)


@query(sql_features("hr_bpm"))
def hr_bpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir, "hr_bpm")


@query(sql_features("rmssd_ms"))
def rmssd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir, "rmssd_ms")


@query(sql_features("sdnn_ms"))
def sdnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir, "sdnn_ms")


@query(sql_features("pnn50_pct"))
def pnn50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir, "pnn50_pct")


@query(sql_features("sd1_ms", "sd2_ms"))
def poincare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir, "sd1_ms", "sd2_ms")


SQL_QC = "round_even(least(greatest(sum(rr_ms) / 1000, 0), first(t_end_s - t_start_s)) / first(t_end_s - t_start_s), 3) AS rr_valid_ratio, round_even(max(gap), 3) AS rr_max_gap_s"


@query(f"{SQL_CUT} SELECT subject_id, w_id, {SQL_QC} FROM d GROUP BY 1, 2")
def rr_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.quality(cut(spark, sf_dir))


@query(f"""{SQL_CUT}, f AS (SELECT subject_id, w_id, 60000 / avg(rr_ms) AS hr_bpm FROM d GROUP BY 1, 2), own AS (SELECT subject_id, w_id, avg(CASE WHEN subject_id % 2 = 0 THEN 60000 / rr_ms END) AS m FROM cut GROUP BY 1, 2)
    SELECT f.subject_id, f.w_id, round(coalesce(m, hr_bpm), 6) AS hr_bpm FROM f LEFT JOIN own ON own.subject_id = f.subject_id AND own.w_id = f.w_id""")
def hr_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    device = V.beats(spark, sf_dir).select("subject_id", "t_s", F.when(F.col("subject_id") % 2 == 0, 60000 / F.col("rr_ms")).alias("bpm"))
    found = T.measured_rate(T.features(cut(spark, sf_dir), ["hr_bpm"]), device, day_windows(spark, sf_dir))
    return rounded(found, "hr_bpm").select("subject_id", "w_id", "hr_bpm")


SQL_F = f"{SQL_CUT}, f AS (SELECT subject_id, w_id, {SQL_TIME['hr_bpm']} AS hr_bpm, {SQL_TIME['rmssd_ms']} AS rmssd_ms, {SQL_TIME['sdnn_ms']} AS sdnn_ms, {SQL_QC} FROM d GROUP BY 1, 2)"


@query(f"{SQL_F} SELECT subject_id, w_id, round(hr_bpm - avg(hr_bpm) OVER p, 6) AS hr_bpm_ws FROM f WINDOW p AS (PARTITION BY subject_id)")
def within_centering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.centred(T.features(cut(spark, sf_dir), ["hr_bpm"]), ["hr_bpm"]), "hr_bpm_ws").select("subject_id", "w_id", "hr_bpm_ws")


@query(f"{SQL_F} SELECT subject_id, w_id, round(avg(hr_bpm) OVER p, 6) AS hr_bpm_bs FROM f WINDOW p AS (PARTITION BY subject_id)")
def between_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.centred(T.features(cut(spark, sf_dir), ["hr_bpm"]), ["hr_bpm"]), "hr_bpm_bs").select("subject_id", "w_id", "hr_bpm_bs")


@query(f"""{SQL_F} SELECT subject_id, w_id, round(hr_bpm, 6) AS hr_bpm, round(rmssd_ms, 6) AS rmssd_ms, round(sdnn_ms, 6) AS sdnn_ms, rr_valid_ratio, rr_max_gap_s,
    round(hr_bpm - avg(hr_bpm) OVER p, 6) AS hr_bpm_ws, CAST(subject_id % 2 AS INTEGER) AS task FROM f WINDOW p AS (PARTITION BY subject_id)""")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: windows, range join, time-domain features, quality, centring and groups in one plan."""
    rows = cut(spark, sf_dir)
    names = ["hr_bpm", "rmssd_ms", "sdnn_ms"]
    both = T.differences(rows).groupBy("subject_id", "w_id").agg(
        *(T.FEATURES[n]().alias(n) for n in names),
        F.first(F.col("t_end_s") - F.col("t_start_s")).alias("_len"), F.sum("rr_ms").alias("_sum"), F.bround(F.max("gap"), 3).alias("rr_max_gap_s"),
    )
    filled = F.bround(F.least(F.greatest(F.col("_sum") / 1000, F.lit(0.0)), F.col("_len")) / F.col("_len"), 3)
    table = T.centred(both.withColumn("rr_valid_ratio", filled), ["hr_bpm"], means=False).withColumn("task", (F.col("subject_id") % 2).cast("int"))
    return rounded(table, *names, "hr_bpm_ws").select("subject_id", "w_id", *names, "rr_valid_ratio", "rr_max_gap_s", "hr_bpm_ws", "task")


# --- acceleration ---

SQL_ACC = f"""WITH {V.SQL_ACC}, sized AS (SELECT subject_id, CAST(floor(time_s / 20) AS INTEGER) + 1 AS w_id, sqrt(value_x ** 2 + value_y ** 2 + value_z ** 2) AS vm FROM acc),
    edge AS (SELECT subject_id, w_id, quantile_cont(vm, 0.2) AS q, count(*) AS n, median(vm) AS m FROM sized GROUP BY 1, 2),
    rest AS (SELECT s.subject_id, s.w_id, CASE WHEN count(*) FILTER (WHERE vm <= q) < greatest(10, 0.05 * first(n)) THEN first(m) ELSE median(vm) FILTER (WHERE vm <= q) END AS own FROM sized s JOIN edge e ON e.subject_id = s.subject_id AND e.w_id = s.w_id GROUP BY 1, 2),
    g AS (SELECT r.subject_id, r.w_id, coalesce(b.own, r.own) AS g0 FROM rest r LEFT JOIN rest b ON b.subject_id = r.subject_id AND b.w_id = 1)"""


@query(f"{SQL_ACC} SELECT s.subject_id, s.w_id, round(avg(greatest(vm - g0, 0)), 6) AS acc_enmo_mean FROM sized s JOIN g ON g.subject_id = s.subject_id AND g.w_id = s.w_id GROUP BY 1, 2")
def acc_enmo(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = V.acc(spark, sf_dir).withColumn("w_id", (F.floor(F.col("time_s") / 20) + 1).cast("int"))
    return rounded(T.enmo(acc), "acc_enmo_mean")


@query(f"""WITH {V.SQL_ACC}, o AS (SELECT subject_id, sqrt(value_x ** 2 + value_y ** 2 + value_z ** 2) AS vm, value_x, time_s - lag(time_s) OVER (PARTITION BY subject_id ORDER BY time_s) AS dt FROM acc),
    c AS (SELECT subject_id, median(vm) AS mv, median(dt) AS md, count(DISTINCT round(value_x, 6)) AS dx FROM o GROUP BY 1)
    SELECT o.subject_id, round(mv, 6) AS median_vm, round(md, 6) AS median_dt, dx AS distinct_x, round(avg(CASE WHEN vm - mv > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS motion_frac, CASE WHEN mv > 100 THEN 'mg' WHEN mv > 5 THEN 'm/s2' ELSE 'g' END AS unit
    FROM o JOIN c ON c.subject_id = o.subject_id GROUP BY 1, mv, md, dx""")
def acc_motion_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.motion(V.acc(spark, sf_dir), 10.0)
    return rounded(found, "median_vm", "median_dt", "motion_frac").select("subject_id", "median_vm", "median_dt", "distinct_x", "motion_frac", "unit")


@query(f"""WITH {V.SQL_ACC}, e AS (SELECT subject_id, CAST(floor(time_s) AS BIGINT) AS second, avg(abs(sqrt(value_x ** 2 + value_y ** 2 + value_z ** 2))) AS v FROM acc GROUP BY 1, 2),
    k AS (SELECT subject_id, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi, count(*) AS n FROM e GROUP BY 1)
    SELECT e.subject_id, second, round(CASE WHEN n < 3 THEN v ELSE least(greatest((v - lo) / nullif(hi - lo, 0), 0), 1) END, 6) AS activity FROM e JOIN k ON k.subject_id = e.subject_id""")
def acc_activity_1hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.activity(V.acc(spark, sf_dir)), "activity")


# --- sources ---

SQL_TRACK = "(SELECT subject_id, CAST(floor((t_s - t0) / 60) AS BIGINT) AS second, avg(60000 / rr_ms) AS bpm FROM (SELECT *, min(t_s) OVER (PARTITION BY subject_id) AS t0 FROM {t}) GROUP BY 1, 2)"


@query(f"""{WITH}, tr AS {SQL_TRACK.format(t='beats')}, g AS (SELECT subject_id, unnest(range(0, max(second) + 1)) AS second FROM tr GROUP BY 1)
    SELECT g.subject_id, CAST(g.second AS BIGINT) AS second, round(bpm, 6) AS bpm FROM g LEFT JOIN tr ON tr.subject_id = g.subject_id AND tr.second = g.second""".replace("/ 60)", "/ 21600)"))
def hr_1hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beats here are hours apart, so the step is six hours."""
    return rounded(B.rate_track(V.beats(spark, sf_dir), 21600.0, full=True), "bpm")


SQL_FLAG = "coalesce(abs(rr_ms / lag(rr_ms) OVER w - 1) > 0.2, false) OR coalesce(60000 / rr_ms < 35 OR 60000 / rr_ms > 140, false)"


@query(f"{WITH} SELECT subject_id, seq, {SQL_FLAG} AS flagged FROM beats {IN_TIME}")
def rr_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.flags(V.beats(spark, sf_dir)).select("subject_id", "seq", "flagged")


SQL_BOTH = f"WITH {V.SQL_BEATS}, {V.SQL_BEATS2}, ta AS {SQL_TRACK.format(t='beats')}, tb AS {SQL_TRACK.format(t='beats2')}".replace("/ 60)", "/ 1)")


@query(f"""{SQL_BOTH}, fa AS (SELECT subject_id, avg(CASE WHEN f THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM (SELECT subject_id, {SQL_FLAG} AS f FROM beats {IN_TIME}) GROUP BY 1),
    fb AS (SELECT subject_id, avg(CASE WHEN f THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM (SELECT subject_id, {SQL_FLAG} AS f FROM beats2 {IN_TIME}) GROUP BY 1),
    ag AS (SELECT ta.subject_id, avg(abs(ta.bpm - tb.bpm)) AS mae, avg(ta.bpm - tb.bpm) AS bias FROM ta JOIN tb ON ta.subject_id = tb.subject_id AND ta.second = tb.second GROUP BY 1),
    sc AS (SELECT fa.subject_id, mae, bias, 0.5 * (1 - fa.p) + 0.3 * (1 - least(coalesce(mae, 0) / 2, 1)) + 0.2 * (1 - least(abs(coalesce(bias, 0)), 1)) AS a, 0.5 * (1 - fb.p) + 0.3 * (1 - least(coalesce(mae, 0) / 2, 1)) + 0.2 * (1 - least(abs(coalesce(bias, 0)), 1)) AS b
        FROM fa JOIN fb ON fa.subject_id = fb.subject_id LEFT JOIN ag ON ag.subject_id = fa.subject_id)
    SELECT subject_id, round(mae, 6) AS mae, round(bias, 6) AS bias, round(a, 6) AS score_device, round(b, 6) AS score_ecg, CASE WHEN round(a, 9) >= round(b, 9) THEN 'device_rr' ELSE 'ecg_rr' END AS choice FROM sc""")
def rr_source_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = B.decision_table(V.beats(spark, sf_dir), V.beats2(spark, sf_dir))
    choice = F.when(F.round("score_device", 9) >= F.round("score_ecg", 9), "device_rr").otherwise("ecg_rr")
    return rounded(table.withColumn("choice", choice), "mae", "bias", "score_device", "score_ecg").select("subject_id", "mae", "bias", "score_device", "score_ecg", "choice")


@query(f"WITH {V.SQL_BEATS}, {V.SQL_BEATS2} SELECT subject_id, source, count(*) AS n, round(sum(rr_ms), 4) AS total FROM (SELECT *, 'device_rr' AS source FROM beats WHERE subject_id % 2 = 0 UNION ALL SELECT *, 'ecg_rr' FROM beats2 WHERE subject_id % 2 = 1) GROUP BY 1, 2")
def rr_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    ecg = V.beats2(spark, sf_dir)
    decisions = ecg.select("subject_id").distinct().withColumn("choice", F.when(F.col("subject_id") % 2 == 0, "device_rr").otherwise("ecg_rr"))
    picked = B.chosen(V.beats(spark, sf_dir), ecg, decisions)
    return picked.groupBy("subject_id", "source").agg(F.count("*").alias("n"), F.round(F.sum("rr_ms"), 4).alias("total"))


@query(f"WITH {V.SQL_BEATS}, {V.SQL_BEATS2}, a AS (SELECT subject_id, min(t_s) AS a0, max(t_s) AS a1 FROM beats GROUP BY 1), b AS (SELECT subject_id, min(t_s + (subject_id % 9 - 4) * 300000) AS b0, max(t_s + (subject_id % 9 - 4) * 300000) AS b1 FROM beats2 GROUP BY 1) SELECT a.subject_id, round(greatest(a0, b0), 3) AS t0, round(least(a1, b1), 3) AS t1 FROM a JOIN b ON a.subject_id = b.subject_id WHERE least(a1, b1) - greatest(a0, b0) >= 10")
def rr_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second source began days before or after the first."""
    later = V.beats2(spark, sf_dir).withColumn("t_s", F.col("t_s") + (F.col("subject_id") % 9 - 4) * 300000)
    return rounded(B.overlap(V.beats(spark, sf_dir), later), "t0", "t1", digits=3)


# --- cleaning ---

SQL_MEDIAN = "m AS (SELECT *, CASE WHEN count(rr_ms) OVER (PARTITION BY subject_id ORDER BY t_s, seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) >= 5 THEN quantile_cont(rr_ms, 0.5) OVER (PARTITION BY subject_id ORDER BY t_s, seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END AS m FROM {t})"
SQL_CAND = "c AS (SELECT *, coalesce(abs(rr_ms - m) / m > 0.2, false) OR coalesce(rr_ms < 510 OR rr_ms > 2000, false) OR coalesce(abs(rr_ms - lag(rr_ms) OVER w) > 150, false) AS cand FROM m " + IN_TIME + ")"
SQL_RUNS = """i AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t_s, seq) AS rn, row_number() OVER (PARTITION BY subject_id, cand ORDER BY t_s, seq) AS rc FROM c),
    r0 AS (SELECT *, CASE WHEN cand THEN count(*) OVER (PARTITION BY subject_id, cand, rn - rc) END AS nb FROM i), r1 AS (SELECT *, CASE WHEN nb <= 10 THEN rn - rc END AS g FROM r0)"""
SQL_CLEAN = f"{WITH}, {SQL_MEDIAN.format(t='beats')}, {SQL_CAND}, {SQL_RUNS}"


@query(f"{WITH}, {SQL_MEDIAN.format(t='beats')} SELECT subject_id, seq, round(m, 6) AS median FROM m")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.beats(spark, sf_dir).withColumn("median", F.round(C.rolling_median("rr_ms"), 6)).select("subject_id", "seq", "median")


@query(f"{WITH}, {SQL_MEDIAN.format(t='beats')}, {SQL_CAND} SELECT subject_id, seq, cand AS candidate FROM c")
def spike_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.candidates(V.beats(spark, sf_dir)).select("subject_id", "seq", "candidate")


@query(f"{SQL_CLEAN} SELECT subject_id, count(*) AS n_beats, round(min(t_s), 3) AS t_start, round(max(t_s), 3) AS t_end FROM r1 WHERE g IS NOT NULL GROUP BY subject_id, g")
def spike_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.runs(V.beats(spark, sf_dir)), "t_start", "t_end", digits=3).select("subject_id", "n_beats", "t_start", "t_end")


@query(f"""{SQL_CLEAN}, p AS (SELECT *, abs(rr_ms + lead(rr_ms) OVER (PARTITION BY subject_id, g ORDER BY t_s, seq) - 2 * coalesce(m, rr_ms)) / (2 * coalesce(m, rr_ms)) AS off FROM r1 WHERE g IS NOT NULL)
    SELECT subject_id, round(min(t_s), 3) AS t_start, coalesce(avg(CASE WHEN off < 0.15 THEN 1.0::DOUBLE WHEN off IS NOT NULL THEN 0.0::DOUBLE END) >= 0.5, false) AS compensation FROM p GROUP BY subject_id, g""")
def compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.runs(V.beats(spark, sf_dir)), "t_start", digits=3).select("subject_id", "t_start", "compensation")


@query(f"""{WITH}, {SQL_MEDIAN.format(t='beats')}, k AS (SELECT *, round_even(rr_ms / m, 0) AS k, t_s - lag(t_s) OVER w AS dt FROM m {IN_TIME}),
    s AS (SELECT *, CASE WHEN rr_ms >= 1200 AND k BETWEEN 2 AND 5 AND abs(rr_ms - k * m) / (k * m) < 0.12 AND dt > 0 THEN CAST(k AS BIGINT) ELSE 1 END AS kk FROM k),
    e AS (SELECT *, unnest(range(1, kk + 1)) AS j FROM s)
    SELECT subject_id, seq, CAST(j AS INTEGER) AS part, round(CASE WHEN kk > 1 THEN t_s - dt + j * dt / kk ELSE t_s END, 3) AS t_s, round(CASE WHEN kk > 1 THEN dt * 1000 / kk ELSE rr_ms END, 3) AS rr_ms FROM e""")
def split_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.split_multiples(V.beats(spark, sf_dir)), "t_s", "rr_ms", digits=3).select("subject_id", "seq", "part", "t_s", "rr_ms")


@query(f"{SQL_CLEAN} SELECT subject_id, seq, round(rr_ms, 6) AS rr_ms FROM r1 WHERE g IS NULL")
def repair_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.dropped(V.beats(spark, sf_dir)), "rr_ms").select("subject_id", "seq", "rr_ms")


@query(f"""{SQL_CLEAN}, n AS (SELECT *, lag(rr_ms) OVER w AS v0, lead(rr_ms) OVER w AS v1, t_s - lag(t_s) OVER w AS d0, lead(t_s) OVER w - t_s AS d1 FROM r1 {IN_TIME})
    SELECT subject_id, seq, round(CASE WHEN g IS NOT NULL AND nb = 1 AND d0 > 0 AND d1 > 0 THEN (v0 * d1 + v1 * d0) / (d0 + d1) ELSE rr_ms END, 6) AS rr_ms, g IS NOT NULL AND NOT coalesce(nb = 1 AND d0 > 0 AND d1 > 0, false) AS bad FROM n""")
def repair_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.weighted_fill(V.beats(spark, sf_dir)), "rr_ms").select("subject_id", "seq", "rr_ms", "bad")


SQL_LINE = """CASE WHEN bad THEN coalesce(v0 + (v1 - v0) * (t_s - t0) / nullif(t1 - t0, 0), v0, v1) ELSE rr_ms END"""
SQL_NEAR = """(SELECT *, last_value(CASE WHEN NOT bad THEN rr_ms END IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN NOT bad THEN t_s END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN NOT bad THEN rr_ms END IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN NOT bad THEN t_s END IGNORE NULLS) OVER a AS t1
    FROM {t} WINDOW b AS (PARTITION BY subject_id ORDER BY t_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY subject_id ORDER BY t_s, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


@query(f"{SQL_CLEAN}, q AS (SELECT *, g IS NOT NULL AS bad FROM r1) SELECT subject_id, seq, round({SQL_LINE}, 6) AS rr_ms FROM {SQL_NEAR.format(t='q')}")
def repair_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = C.with_runs(V.beats(spark, sf_dir)).withColumn("bad", F.col("run").isNotNull())
    return rounded(C.linear_fill(marked), "rr_ms").select("subject_id", "seq", "rr_ms")


SQL_PCHIP = f"""{SQL_CLEAN}, q AS (SELECT subject_id, seq, t_s, rr_ms, g IS NOT NULL AS bad FROM r1),
    g0 AS (SELECT *, t_s - lag(t_s) OVER w AS h0, lead(t_s) OVER w - t_s AS h1, (rr_ms - lag(rr_ms) OVER w) / (t_s - lag(t_s) OVER w) AS d0, (lead(rr_ms) OVER w - rr_ms) / (lead(t_s) OVER w - t_s) AS d1 FROM q WHERE NOT bad {IN_TIME}),
    g1 AS (SELECT *, lag(d0) OVER w AS dm, lag(h0) OVER w AS hm, lead(d1) OVER w AS dp, lead(h1) OVER w AS hp FROM g0 {IN_TIME}),
    g2 AS (SELECT *, CASE WHEN d0 IS NULL THEN ((2 * h1 + hp) * d1 - h1 * dp) / (h1 + hp) WHEN d1 IS NULL THEN ((2 * h0 + hm) * d0 - h0 * dm) / (h0 + hm) END AS e, coalesce(d0, d1) AS x0, CASE WHEN d0 IS NULL THEN dp ELSE dm END AS x1 FROM g1),
    g3 AS (SELECT subject_id, seq, CASE WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN CASE WHEN d0 * d1 <= 0 THEN 0 ELSE (3 * h1 + 3 * h0) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) END
        WHEN (CASE WHEN d0 IS NULL THEN dp ELSE dm END) IS NULL THEN coalesce(d0, d1)
        WHEN sign(e) <> sign(coalesce(d0, d1)) THEN 0
        WHEN sign(coalesce(d0, d1)) <> sign(CASE WHEN d0 IS NULL THEN dp ELSE dm END) AND abs(e) > 3 * abs(coalesce(d0, d1)) THEN 3 * coalesce(d0, d1) ELSE e END AS slope FROM g2),
    j AS (SELECT q.*, slope FROM q LEFT JOIN g3 ON g3.subject_id = q.subject_id AND g3.seq = q.seq),
    near AS (SELECT *, last_value(slope IGNORE NULLS) OVER b AS m0, first_value(slope IGNORE NULLS) OVER a AS m1 FROM {SQL_NEAR.format(t='j')} WINDOW b AS (PARTITION BY subject_id ORDER BY t_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY subject_id ORDER BY t_s, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    z AS (SELECT *, t1 - t0 AS h, (t_s - t0) / (t1 - t0) AS s FROM near)"""


@query(f"{SQL_PCHIP} SELECT subject_id, seq, round(CASE WHEN bad THEN coalesce((2*s**3 - 3*s**2 + 1) * v0 + (s**3 - 2*s**2 + s) * h * m0 + (3*s**2 - 2*s**3) * v1 + (s**3 - s**2) * h * m1, v0 + (v1 - v0) * s, v0, v1) ELSE rr_ms END, 4) AS rr_ms FROM z")
def repair_pchip(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = C.with_runs(V.beats(spark, sf_dir)).withColumn("bad", F.col("run").isNotNull())
    return rounded(C.cubic_fill(marked), "rr_ms", digits=4).select("subject_id", "seq", "rr_ms")


SQL_PARTS = f"""{WITH}, {SQL_MEDIAN.format(t='beats')}, k AS (SELECT *, round_even(rr_ms / m, 0) AS k, t_s - lag(t_s) OVER w AS dt FROM m {IN_TIME}),
    s AS (SELECT *, CASE WHEN rr_ms >= 1200 AND k BETWEEN 2 AND 5 AND abs(rr_ms - k * m) / (k * m) < 0.12 AND dt > 0 THEN CAST(k AS BIGINT) ELSE 1 END AS kk FROM k), e AS (SELECT *, unnest(range(1, kk + 1)) AS j FROM s)
    SELECT subject_id, seq, CASE WHEN kk > 1 THEN t_s - dt + j * dt / kk ELSE t_s END AS t_s, CASE WHEN kk > 1 THEN dt * 1000 / kk ELSE rr_ms END AS rr_ms FROM e"""
SQL_DEVICE = SQL_PCHIP.replace(WITH, f"WITH parts AS ({SQL_PARTS}), named AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t_s, seq) AS place FROM parts), beats AS (SELECT subject_id, place AS seq, t_s, rr_ms FROM named)", 1)


@query(f"{SQL_DEVICE} SELECT z.subject_id, named.seq, round(z.t_s, 3) AS t_s, round(CASE WHEN bad THEN coalesce((2*s**3 - 3*s**2 + 1) * v0 + (s**3 - 2*s**2 + s) * h * m0 + (3*s**2 - 2*s**3) * v1 + (s**3 - s**2) * h * m1, v0 + (v1 - v0) * s, v0, v1) ELSE z.rr_ms END, 3) AS rr_ms FROM z JOIN named ON named.subject_id = z.subject_id AND named.place = z.seq")
def clean_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.cleaned(V.beats(spark, sf_dir)), "t_s", "rr_ms", digits=3)


SQL_MARKS = f"""{WITH}, o AS (SELECT *, first_value(rr_ms) OVER u AS f, last_value(rr_ms) OVER u AS l FROM beats WINDOW u AS (PARTITION BY subject_id ORDER BY t_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    e AS (SELECT *, list_sort([coalesce(lag(rr_ms, 2) OVER w, f), coalesce(lag(rr_ms) OVER w, f), rr_ms, coalesce(lead(rr_ms) OVER w, l), coalesce(lead(rr_ms, 2) OVER w, l)])[3] AS m5, lag(rr_ms) OVER w AS p FROM o {IN_TIME}),
    mk AS (SELECT subject_id, seq, t_s, rr_ms, rr_ms < 510 OR rr_ms > 2000 OR coalesce(abs(rr_ms - p) / p > 0.2, false) OR abs(rr_ms - m5) / m5 > 0.2 AS b0, rr_ms < 0.9 * m5 AS low FROM e),
    rn AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t_s, seq) - row_number() OVER (PARTITION BY subject_id, b0 ORDER BY t_s, seq) AS g FROM mk),
    nr AS (SELECT *, (b0 AND count(*) OVER (PARTITION BY subject_id, b0, g) <= 10) OR low AS near FROM rn), an AS (SELECT *, bool_or(near) OVER (PARTITION BY subject_id) AS hit FROM nr), q1 AS (SELECT subject_id, seq, t_s, rr_ms, hit AND (b0 OR low) AS bad, near AND hit AS near FROM an)"""
SQL_SMOOTH = f"""{SQL_MARKS}, l1 AS (SELECT subject_id, seq, t_s, bad, near, {SQL_LINE} AS rr_ms FROM {SQL_NEAR.format(t='q1')}),
    x1 AS (SELECT *, near OR coalesce(lag(near) OVER w, false) OR coalesce(lead(near) OVER w, false) AS cl, lag(rr_ms) OVER w AS a, lead(rr_ms) OVER w AS c FROM l1 {IN_TIME}),
    s1 AS (SELECT subject_id, seq, t_s, bad, CASE WHEN cl AND a IS NOT NULL AND c IS NOT NULL THEN list_sort([a, rr_ms, c])[2] ELSE rr_ms END AS rr_ms FROM x1),
    q2 AS (SELECT subject_id, seq, t_s, rr_ms, bad AND coalesce(abs(rr_ms / lag(rr_ms) OVER w - 1) > 0.2, false) AS bad FROM s1 {IN_TIME})"""


@query(f"{SQL_SMOOTH} SELECT subject_id, seq, round(t_s, 3) AS t_s, round({SQL_LINE}, 3) AS rr_ms FROM {SQL_NEAR.format(t='q2')}")
def clean_ecg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.cleaned_ecg(V.beats(spark, sf_dir)), "t_s", "rr_ms", digits=3)


@query(f"""{WITH}, o AS (SELECT *, first_value(rr_ms) OVER u AS f, last_value(rr_ms) OVER u AS l FROM beats WINDOW u AS (PARTITION BY subject_id ORDER BY t_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    e AS (SELECT *, list_sort([coalesce(lag(rr_ms, 2) OVER w, f), coalesce(lag(rr_ms) OVER w, f), rr_ms, coalesce(lead(rr_ms) OVER w, l), coalesce(lead(rr_ms, 2) OVER w, l)])[3] AS m5, lag(rr_ms) OVER w AS p FROM o {IN_TIME})
    SELECT subject_id, seq, rr_ms < 510 OR rr_ms > 2000 OR coalesce(abs(rr_ms - p) / p > 0.2, false) OR abs(rr_ms - m5) / m5 > 0.2 AS bad, rr_ms < 0.9 * m5 AS low FROM e""")
def ecg_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ecg_marks(V.beats(spark, sf_dir)).select("subject_id", "seq", "bad", "low")


@query(f"""{WITH}, iv AS (SELECT subject_id, seq % 97 AS a, seq % 97 + seq % 5 AS b FROM beats), o AS (SELECT *, max(b) OVER (PARTITION BY subject_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv),
    n AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT subject_id, min(a) AS start, max(b) AS "end" FROM n GROUP BY subject_id, g""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.beats(spark, sf_dir).selectExpr("subject_id", "seq % 97 AS start", "seq % 97 + seq % 5 AS end")
    return C.merged_intervals(rows)


@query(f"""{WITH}, n AS (SELECT *, seq % 11 = 0 AS near FROM beats), x AS (SELECT *, near OR coalesce(lag(near) OVER w, false) OR coalesce(lead(near) OVER w, false) AS cl, lag(rr_ms) OVER w AS a, lead(rr_ms) OVER w AS c FROM n {IN_TIME})
    SELECT subject_id, seq, round(CASE WHEN cl AND a IS NOT NULL AND c IS NOT NULL THEN list_sort([a, rr_ms, c])[2] ELSE rr_ms END, 6) AS rr_ms FROM x""")
def median3_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.smoothed_near(V.beats(spark, sf_dir).withColumn("near", F.col("seq") % 11 == 0)), "rr_ms").select("subject_id", "seq", "rr_ms")


@query(f"""{SQL_CLEAN}, q AS (SELECT subject_id, count(DISTINCT g) AS n_segments, count(g) AS n_corrected, count(g)::DOUBLE / count(*) AS r FROM r1 GROUP BY 1)
    SELECT subject_id, n_segments, n_corrected, round_even(r, 4) AS ratio_corrected, concat_ws('; ', CASE WHEN n_segments >= 4 THEN 'segments=' || n_segments END, CASE WHEN r >= 0.05 THEN 'many corrected' END) AS warning FROM q""")
def clean_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quality(V.beats(spark, sf_dir))


@query(f"""{SQL_CLEAN}, {V.SQL_BEATS2}, rn AS (SELECT subject_id, g, min(t_s) AS a, max(t_s) AS b FROM r1 WHERE g IS NOT NULL GROUP BY 1, 2),
    jn AS (SELECT r.subject_id, g, x.rr_ms FROM rn r JOIN beats2 x ON x.subject_id = r.subject_id AND x.t_s BETWEEN a - 100000 AND b + 100000),
    ce AS (SELECT subject_id, g, median(rr_ms) AS m FROM jn GROUP BY 1, 2 HAVING count(*) >= 3), de AS (SELECT jn.subject_id, jn.g, median(abs(rr_ms - m) / m) AS d FROM jn JOIN ce ON ce.subject_id = jn.subject_id AND ce.g = jn.g GROUP BY 1, 2)
    SELECT subject_id, bool_or(d > 0.15) AS both_bad FROM de GROUP BY 1""")
def both_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.both_bad(V.beats(spark, sf_dir), V.beats2(spark, sf_dir), reach=100000.0)


# --- the same in pieces of a subject's beats: results, and so the SQL, are those of one window over all of them ---

#: A user of the sample tables has some dozens of beats, hours apart.
CUT = Pieces(rows=20, seconds=5 * DAY)


@query(ORACLES["rolling_median"])
def rolling_median_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.medians(V.beats(spark, sf_dir), pieces=CUT), "median").select("subject_id", "seq", "median")


@query(ORACLES["spike_candidates"])
def spike_candidates_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.candidates(V.beats(spark, sf_dir), pieces=CUT).select("subject_id", "seq", "candidate")


@query(ORACLES["spike_runs"])
def spike_runs_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.runs(V.beats(spark, sf_dir), pieces=CUT), "t_start", "t_end", digits=3).select("subject_id", "n_beats", "t_start", "t_end")


@query(ORACLES["compensation"])
def compensation_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.runs(V.beats(spark, sf_dir), pieces=CUT), "t_start", digits=3).select("subject_id", "t_start", "compensation")


@query(ORACLES["split_multiples"])
def split_multiples_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.split_multiples(V.beats(spark, sf_dir), pieces=CUT), "t_s", "rr_ms", digits=3).select("subject_id", "seq", "part", "t_s", "rr_ms")


@query(ORACLES["repair_delete"])
def repair_delete_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.dropped(V.beats(spark, sf_dir), pieces=CUT), "rr_ms").select("subject_id", "seq", "rr_ms")


@query(ORACLES["repair_fill"])
def repair_fill_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.weighted_fill(V.beats(spark, sf_dir), pieces=CUT), "rr_ms").select("subject_id", "seq", "rr_ms", "bad")


@query(ORACLES["repair_linear"])
def repair_linear_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = C.with_runs(V.beats(spark, sf_dir), pieces=CUT).withColumn("bad", F.col("run").isNotNull())
    return rounded(C.linear_fill(marked, pieces=CUT), "rr_ms").select("subject_id", "seq", "rr_ms")


@query(ORACLES["repair_pchip"])
def repair_pchip_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = checkpoint(C.with_runs(V.beats(spark, sf_dir), pieces=CUT).withColumn("bad", F.col("run").isNotNull()))
    return rounded(C.cubic_fill(marked, pieces=CUT), "rr_ms", digits=4).select("subject_id", "seq", "rr_ms")


@query(ORACLES["ecg_marks"])
def ecg_marks_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ecg_marks(V.beats(spark, sf_dir), pieces=CUT).select("subject_id", "seq", "bad", "low")


@query(ORACLES["median3_smooth"])
def median3_smooth_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = V.beats(spark, sf_dir).withColumn("near", F.col("seq") % 11 == 0)
    return rounded(C.smoothed_near(beats, pieces=CUT), "rr_ms").select("subject_id", "seq", "rr_ms")
