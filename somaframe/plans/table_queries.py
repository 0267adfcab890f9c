"""Queries of the table, scoring, statistics and preview operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaframe.config import Scale
from somaframe.operators import preview as P
from somaframe.operators import scoring as S
from somaframe.operators import stats as D
from somaframe.operators import tables as T
from somaframe.operators import time_domain as TD
from somaframe.plans.beat_queries import SQL_CUT, cut, rounded
from somaframe.plans.registry import query
from somaframe.sources import sample_views as V

ITEMS = f"WITH {V.SQL_ITEMS}"
SCALES = {"calm": Scale(("q1", "q2"), frozenset({"q1"})), "focus": Scale(("q3", "q4")), "state": Scale(("calm", "focus"))}
CALM, FOCUS = "((6 - q1 + q2) / 2)", "((q3 + q4) / 2)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.items(spark, sf_dir)


# --- scoring ---


@query(f"{ITEMS} SELECT subject_id, time, 6 - q1 AS q1_r FROM items")
def reverse_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("subject_id", "time", S.reversed_item(F.col("q1")).alias("q1_r"))


@query(f"{ITEMS} SELECT subject_id, time, (q1 + q2 + q3) / 3 AS m FROM items")
def strict_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("subject_id", "time", S.strict_mean([F.col("q1"), F.col("q2"), F.col("q3")]).alias("m"))


@query(f"{ITEMS} SELECT subject_id, time, list_avg([q1, q2, q3, q4]) AS m FROM items")
def lenient_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("subject_id", "time", S.lenient_mean([F.col(f"q{k}") for k in (1, 2, 3, 4)]).alias("m"))


@query(f"{ITEMS} SELECT subject_id, time, {CALM} AS calm, {FOCUS} AS focus, ({CALM} + {FOCUS}) / 2 AS state FROM items")
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scored(items(spark, sf_dir), SCALES)


@query(f"{ITEMS} SELECT subject_id, time, list_avg([5 - q1, q2]) AS stai FROM items")
def lenient_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other convention: items 0 to 5 reversed, missing ones left out."""
    return items(spark, sf_dir).select("subject_id", "time", S.construct("stai", {"stai": Scale(("q1", "q2"), frozenset({"q1"}))}, S.lenient_mean, 0, 5).alias("stai"))


@query(f"{ITEMS} SELECT subject_id, time, arg_min(q2, time) FILTER (WHERE q2 IS NOT NULL) OVER (PARTITION BY subject_id) AS q2 FROM items")
def static_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.static_filled(items(spark, sf_dir), ["q2"]).select("subject_id", "time", "q2")


SQL_CENTRE = f"{ITEMS}, f AS (SELECT subject_id, arg_min(q1, time) FILTER (WHERE q1 IS NOT NULL) AS v FROM items GROUP BY 1), g AS (SELECT avg(v) AS m FROM f)"


@query(f"{SQL_CENTRE} SELECT subject_id, time, round(q1 - m, 6) AS q1_c FROM items CROSS JOIN g")
def grand_mean_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.centred(items(spark, sf_dir), ["q1"]), "q1_c").select("subject_id", "time", "q1_c")


@query(f"{SQL_CENTRE} SELECT subject_id, time, round((q1 - m) * task, 6) + 0.0 AS q1_inter FROM items CROSS JOIN g")
def interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.interactions(S.centred(items(spark, sf_dir), ["q1"]), ["q1"], "task")
    return rows.select("subject_id", "time", (F.round("q1_inter", 6) + 0.0).alias("q1_inter"))


SQL_AT = "max(CASE WHEN time = {t} THEN q1 END) OVER (PARTITION BY subject_id)"


@query(f"{ITEMS} SELECT subject_id, time, {SQL_AT.format(t=2)} - {SQL_AT.format(t=1)} AS q121, {SQL_AT.format(t=3)} - {SQL_AT.format(t=1)} AS q131, {SQL_AT.format(t=3)} - {SQL_AT.format(t=2)} AS q132 FROM items")
def time_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.time_deltas(items(spark, sf_dir), ["q1"], [1, 2, 3]).select("subject_id", "time", "q121", "q131", "q132")


@query(f"{ITEMS} SELECT time, count(*) AS n, count(q1) AS q1, CASE WHEN time = 1 THEN count(q4) ELSE 0 END AS q4 FROM items GROUP BY 1")
def stacked_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    both = S.stacked({1: rows.where("time = 1").drop("time"), 2: rows.where("time = 2").drop("time", "q4"), 3: rows.where("time = 3").drop("time", "q4")})
    return both.groupBy(F.col("time").cast("bigint").alias("time")).agg(F.count("*").alias("n"), F.count("q1").alias("q1"), F.count("q4").alias("q4"))


@query(f"{ITEMS} SELECT round(avg(CASE WHEN subject_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS hit_rate FROM (SELECT DISTINCT subject_id FROM items)")
def group_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    known = rows.withColumn("subject_id", F.when(F.col("subject_id") % 3 == 0, F.col("subject_id")).otherwise(-F.col("subject_id")))
    return rounded(S.hit_rate(rows, known), "hit_rate", digits=9)


# --- tables ---

SQL_FEATURES = f"{SQL_CUT}, f AS (SELECT subject_id, w_id, 60000 / avg(rr_ms) AS hr_bpm, sqrt(avg(d * d)) AS rmssd_ms FROM d GROUP BY 1, 2)"
MEANINGS = {1: "p_baseline", 2: "g_t1", 3: "p_induction", 4: "g_t2", 5: "p_intervention", 6: "g_recovery"}


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TD.features(cut(spark, sf_dir), ["hr_bpm", "rmssd_ms"])


@query(f"{SQL_FEATURES} SELECT subject_id, w_id, round(hr_bpm, 6) AS hr_bpm, CASE WHEN subject_id % 5 > 0 THEN CAST(subject_id % 2 AS DOUBLE) END AS task FROM f")
def physio_join_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    known = F.when(F.col("subject_id") % 5 > 0, F.col("subject_id")).otherwise(-F.col("subject_id") - 1)
    groups = rows.select(known.alias("subject_id"), (F.col("subject_id") % 2).cast("int").alias("task"))
    return rounded(T.with_groups(rows, groups), "hr_bpm").select("subject_id", "w_id", "hr_bpm", F.col("task").cast("double").alias("task"))


@query(f"{ITEMS} SELECT subject_id, count(DISTINCT q1) AS n FROM items GROUP BY 1 HAVING count(DISTINCT q1) > 1")
def group_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.conflicting(items(spark, sf_dir), "q1")


def sql_cells(label: str, values: list, names: list[str], column: str = "hr_bpm") -> str:
    return ", ".join(f"round(max(CASE WHEN {label} = {v!r} THEN {column} END), 6) AS {column}_{n}" for v, n in zip(values, names, strict=True))


@query(f"{SQL_FEATURES} SELECT subject_id, {sql_cells('w_id', [1, 2, 3, 4], list(T.PHASES.values()))}, {sql_cells('w_id', [1, 2, 3, 4], list(T.PHASES.values()), 'rmssd_ms')} FROM f GROUP BY 1")
def wide_pivot_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).withColumn("phase", T.phase(F.col("w_id")))
    table = T.wide(rows, "subject_id", "phase", list(T.PHASES.values()), ["hr_bpm", "rmssd_ms"], "w_id")
    return rounded(table, *(c for c in table.columns if c != "subject_id"))


def meant(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(*(F.when(F.col("w_id") == k, v) for k, v in MEANINGS.items()))
    return features(spark, sf_dir).withColumns({"meaning": F.concat(name, F.lit(" (x)")), "task": (F.col("subject_id") % 2).cast("int")})


@query(f"{SQL_FEATURES} SELECT subject_id, {sql_cells('w_id', [1, 2, 3, 4, 5], ['baseline', 't1', 'induction', 't2', 'intervention'])} FROM f GROUP BY 1")
def wide_pivot_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.labelled(meant(spark, sf_dir), T.scheme(spark))
    table = T.wide(rows, "subject_id", "col_suffix", ["baseline", "t1", "induction", "t2", "intervention"], ["hr_bpm"], "w_id")
    return rounded(table, *(c for c in table.columns if c != "subject_id"))


SQL_LONG = """lg AS (SELECT subject_id, CAST(subject_id % 2 AS INTEGER) AS task, w_id, CASE w_id WHEN 2 THEN 1 WHEN 4 THEN 2 END AS t_id, CASE WHEN w_id IN (2, 4) THEN 'gap' ELSE 'phase' END AS role,
    CASE w_id WHEN 1 THEN 'baseline' WHEN 3 THEN 'induction' WHEN 5 THEN 'intervention' END AS phase_level, CASE w_id WHEN 2 THEN 't1' WHEN 4 THEN 't2' END AS t_level, CASE w_id WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 3 END AS phase_level_code, hr_bpm FROM f)"""


@query(f"{SQL_FEATURES}, {SQL_LONG} SELECT subject_id, task, w_id, t_id::DOUBLE AS t_id, role, phase_level, t_level, phase_level_code::DOUBLE AS phase_level_code, round(hr_bpm, 6) AS hr_bpm FROM lg")
def long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.long_table(meant(spark, sf_dir), T.scheme(spark), ["hr_bpm"]), "hr_bpm").drop("meaning").withColumns({c: F.col(c).cast("double") for c in ("t_id", "phase_level_code")})


@query(f"{SQL_FEATURES}, {V.SQL_ITEMS}, {SQL_LONG} SELECT lg.subject_id, w_id, t_id::DOUBLE AS t_id, q1 FROM lg LEFT JOIN items i ON i.subject_id = lg.subject_id AND i.time = lg.t_id")
def psycho_merge_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.long_table(meant(spark, sf_dir), T.scheme(spark), ["hr_bpm"])
    return T.with_questionnaires(rows, items(spark, sf_dir), ["q1"]).select("subject_id", "w_id", F.col("t_id").cast("double").alias("t_id"), "q1")


@query(f"{ITEMS} SELECT subject_id, max(CASE WHEN time = 1 THEN q1 END) AS \"q1_T1\", max(CASE WHEN time = 2 THEN q1 END) AS \"q1_T2\", max(CASE WHEN time = 3 THEN q1 END) AS \"q1_T3\" FROM items GROUP BY 1")
def psycho_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.by_time(items(spark, sf_dir), ["q1"], [1, 2, 3])


@query(f"{ITEMS}, e AS (SELECT subject_id, count(DISTINCT q1) AS a, count(DISTINCT task) AS b FROM items GROUP BY 1) SELECT 'q1' AS name, avg(CASE WHEN a <= 1 THEN 1 ELSE 0 END) >= 0.9 AS static FROM e UNION ALL SELECT 'task', avg(CASE WHEN b <= 1 THEN 1 ELSE 0 END) >= 0.9 FROM e")
def static_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.static_columns(items(spark, sf_dir), ["q1", "task"])
    return spark.createDataFrame([(c, c in found) for c in ("q1", "task")], "name string, static boolean")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def drop_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(" NA ").alias("blank"), F.lit(None).cast("double").alias("none"))
    return rows.select(*T.filled_columns(rows))


@query(f"{ITEMS}, w AS (SELECT subject_id, max(CASE WHEN time = 1 THEN q1 END) AS a, max(CASE WHEN time = 2 THEN q1 END) AS b, max(CASE WHEN time = 3 THEN q1 END) AS c FROM items GROUP BY 1) SELECT subject_id, b - a AS d_q1_induction, c - b AS d_q1_intervention FROM w")
def delta_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_deltas(T.by_time(items(spark, sf_dir), ["q1"], [1, 2, 3]), "q1").select("subject_id", "d_q1_induction", "d_q1_intervention")


@query(f"{ITEMS} SELECT subject_id, max(task) AS task, max(CASE WHEN time = 1 THEN q1 END) AS \"q1_T1\", max(CASE WHEN time = 2 THEN q1 END) AS \"q1_T2\", max(CASE WHEN time = 3 THEN q1 END) AS \"q1_T3\" FROM items GROUP BY 1")
def collapsed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task is the same at all times that a subject has; some subjects lack one or two."""
    return T.collapsed(T.by_time(items(spark, sf_dir), ["task", "q1"], [1, 2, 3]))


@query(f"{SQL_FEATURES}, {V.SQL_ITEMS}, a AS (SELECT subject_id, avg(hr_bpm) AS hr FROM f GROUP BY 1), b AS (SELECT subject_id, avg(q1) AS q1 FROM items GROUP BY 1) SELECT a.subject_id, round(hr, 6) AS hr, round(q1, 6) AS q1 FROM a LEFT JOIN b ON a.subject_id = b.subject_id")
def wide_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = features(spark, sf_dir).groupBy("subject_id").agg(F.avg("hr_bpm").alias("hr"))
    right = items(spark, sf_dir).groupBy("subject_id").agg(F.avg("q1").alias("q1"))
    return rounded(T.joined_once(left, right, "subject_id"), "hr", "q1")


# --- statistics ---

SQL_STATS = "avg({v}) AS mean, CASE WHEN count({v}) <= 1 THEN 0 ELSE stddev_samp({v}) END AS std, count({v}) AS count"


@query(f"{ITEMS}, s AS (SELECT subject_id, {SQL_STATS.format(v='q1')} FROM items GROUP BY 1) SELECT subject_id, round(mean, 6) AS mean, round(std, 6) AS std, count, round(std / nullif(mean, 0), 6) AS cv FROM s")
def desc_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.described(items(spark, sf_dir), "q1"), "mean", "std", "cv")


@query(f"{ITEMS}, s AS (SELECT subject_id, time, {SQL_STATS.format(v='q1')} FROM items GROUP BY 1, 2) SELECT subject_id, time, round(mean, 6) AS mean, round(std, 6) AS std, count, round(std / nullif(mean, 0), 6) AS cv FROM s")
def desc_by_subject_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.described(items(spark, sf_dir), "q1", ("subject_id", "time")), "mean", "std", "cv")


SQL_INFLUENCE = """e AS (SELECT {by} subject_id, count(q1) AS n, avg(q1) AS mean FROM items WHERE q1 IS NOT NULL GROUP BY ALL), g AS (SELECT {by} avg(q1) AS gm, sum((q1) ** 2) - sum(q1) ** 2 / count(q1) AS tot FROM items WHERE q1 IS NOT NULL GROUP BY ALL),
    b AS (SELECT {ej} e.*, gm, tot, n * (mean - gm) ** 2 AS ss FROM e JOIN g ON {on}), z AS (SELECT *, sum(ss) OVER p AS bet, avg(mean) OVER p AS mm, stddev_samp(mean) OVER p AS ms FROM b WINDOW p AS ({part}))"""
SQL_INFLUENCE_OUT = "subject_id, n, round(mean, 6) AS mean, round(ss, 6) AS between_ss, round(ss / nullif(bet, 0), 6) AS share_between, round(ss / nullif(tot, 0), 6) AS share_total, round((mean - mm) / nullif(ms, 0), 6) AS z"
INFLUENCE = ("mean", "between_ss", "share_between", "share_total", "z")


@query(f"{ITEMS}, {SQL_INFLUENCE.format(by='', ej='', on='true', part='')} SELECT {SQL_INFLUENCE_OUT} FROM z")
def variance_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.influence(items(spark, sf_dir), "q1"), *INFLUENCE)


@query(f"{ITEMS}, {SQL_INFLUENCE.format(by='task,', ej='', on='e.task = g.task', part='PARTITION BY task')} SELECT task, {SQL_INFLUENCE_OUT} FROM z")
def variance_influence_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.influence(items(spark, sf_dir), "q1", ["task"]), *INFLUENCE)


@query(f"""{ITEMS}, c AS (SELECT subject_id, task, avg(CASE WHEN time = 1 THEN q1 END) AS a, avg(CASE WHEN time = 2 THEN q1 END) AS b, avg(CASE WHEN time = 3 THEN q1 END) AS c FROM items GROUP BY 1, 2)
    SELECT subject_id, task, b - a AS sl_12, round(avg(b - a) OVER p, 6) AS grp_sl_12, round(b - a - avg(b - a) OVER p, 6) AS d_sl_12, c - b AS sl_23, round(avg(c - b) OVER p, 6) AS grp_sl_23, round(c - b - avg(c - b) OVER p, 6) AS d_sl_23 FROM c WINDOW p AS (PARTITION BY task)""")
def interval_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.slopes(items(spark, sf_dir), "q1", [1, 2, 3], "task", "time"), "grp_sl_12", "d_sl_12", "grp_sl_23", "d_sl_23")


@query(f"{ITEMS}, e AS (SELECT task, subject_id, time, avg(q1) AS m FROM items GROUP BY 1, 2, 3) SELECT task::DOUBLE AS task, time, round(avg(m), 6) AS mean, count(m) AS n, CAST(grouping(task) AS INTEGER) AS overall FROM e GROUP BY GROUPING SETS ((time), (task, time))")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.trajectories(items(spark, sf_dir), "q1", "task", "time").withColumns({"overall": F.col("overall").cast("int"), "task": F.col("task").cast("double")}), "mean")


@query("""WITH v AS (SELECT 'l_quantity' AS name, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
    SELECT name, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max FROM v GROUP BY 1""")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.summary(V.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"]), "mean", "std", "q25", "q50", "q75")


@query("WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT l_returnflag, CAST(least(floor((l_quantity - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem CROSS JOIN e GROUP BY 1, 2")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.histogram(V.table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1")
def ols_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.line(V.table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]), "slope", "intercept", digits=4)


SQL_PLANE = """m AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS y, avg(l_quantity) AS x, avg(l_discount) AS z, covar_samp(l_quantity, l_extendedprice) AS xy, covar_samp(l_discount, l_extendedprice) AS zy, covar_samp(l_quantity, l_discount) AS xz, var_samp(l_quantity) AS xx, var_samp(l_discount) AS zz FROM lineitem GROUP BY 1),
    p AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM m)"""


@query(f"WITH {SQL_PLANE} SELECT l_returnflag, n, round(y - b1 * x - b2 * z, 3) AS b0, round(b1, 4) AS b1, round(b2, 3) AS b2 FROM p")
def ols_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.plane(V.table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_discount", ["l_returnflag"])
    return rounded(rounded(found, "b0", "b2", digits=3), "b1", digits=4)


@query(f"WITH {SQL_PLANE} SELECT l.l_returnflag, round(avg(l_extendedprice - b2 * (l_discount - z)), 3) AS mean_adj, round(stddev_samp(l_extendedprice - b2 * (l_discount - z)), 3) AS sd_adj FROM lineitem l JOIN p ON p.l_returnflag = l.l_returnflag GROUP BY 1")
def ols_adjusted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.adjusted(V.table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_discount", ["l_returnflag"])
    return rows.groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice_adj"), 3).alias("mean_adj"), F.round(F.stddev_samp("l_extendedprice_adj"), 3).alias("sd_adj"))


METRICS = {"q1": 1, "q2": 2}
SQL_SD = "sd AS (SELECT task, stddev_samp(CASE WHEN time = 1 THEN q1 END) AS a1, stddev_samp(CASE WHEN time = 2 THEN q1 END) AS a2, stddev_samp(CASE WHEN time = 1 THEN q2 END) AS b1, stddev_samp(CASE WHEN time = 2 THEN q2 END) AS b2 FROM items GROUP BY 1)"
SQL_Z = f"""{ITEMS}, {SQL_SD}, v AS (SELECT subject_id, task, avg(CASE WHEN time = 1 THEN q1 END) AS x1, avg(CASE WHEN time = 2 THEN q1 END) AS x2, avg(CASE WHEN time = 3 THEN q1 END) AS x3, avg(CASE WHEN time = 1 THEN q2 END) AS y1, avg(CASE WHEN time = 2 THEN q2 END) AS y2, avg(CASE WHEN time = 3 THEN q2 END) AS y3 FROM items GROUP BY 1, 2),
    l AS (SELECT subject_id, v.task, 1 AS indicator, 1 AS time, (x2 - x1) / nullif(a1, 0) AS z FROM v JOIN sd ON sd.task = v.task WHERE coalesce(x1, x2, x3) IS NOT NULL UNION ALL SELECT subject_id, v.task, 1, 2, (x3 - x2) / nullif(a2, 0) FROM v JOIN sd ON sd.task = v.task WHERE coalesce(x1, x2, x3) IS NOT NULL
    UNION ALL SELECT subject_id, v.task, 2, 1, (y2 - y1) / nullif(b1, 0) FROM v JOIN sd ON sd.task = v.task WHERE coalesce(y1, y2, y3) IS NOT NULL UNION ALL SELECT subject_id, v.task, 2, 2, (y3 - y2) / nullif(b2, 0) FROM v JOIN sd ON sd.task = v.task WHERE coalesce(y1, y2, y3) IS NOT NULL)"""


@query(f"{ITEMS}, {SQL_SD} SELECT task, round(a1, 6) AS sd_1, round(a2, 6) AS sd_2 FROM sd")
def zchange_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.group_deviation(items(spark, sf_dir), "q1", [1, 2], "task", "time"), "sd_1", "sd_2")


@query(f"{SQL_Z} SELECT subject_id, task, indicator, time, round(z, 6) AS z FROM l")
def zchange_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.changes(items(spark, sf_dir), METRICS, "task", "time"), "z")


SQL_ZWIDE = "w AS (SELECT subject_id, task, max(CASE WHEN indicator = 1 AND time = 1 THEN z END) AS z12_q1, max(CASE WHEN indicator = 1 AND time = 2 THEN z END) AS z23_q1, max(CASE WHEN indicator = 2 AND time = 1 THEN z END) AS z12_q2, max(CASE WHEN indicator = 2 AND time = 2 THEN z END) AS z23_q2 FROM l GROUP BY 1, 2)"
ZWIDE = ("z12_q1", "z23_q1", "z12_q2", "z23_q2")


@query(f"{SQL_Z}, {SQL_ZWIDE} SELECT subject_id, task, {', '.join(f'round({c}, 6) AS {c}' for c in ZWIDE)} FROM w")
def zchange_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.changes_wide(D.changes(items(spark, sf_dir), METRICS, "task", "time"), METRICS), *ZWIDE)


@query(f"{SQL_Z}, {SQL_ZWIDE} SELECT table_type, count(*) AS n, count(z) AS z, count(z12_q1) AS z12_q1 FROM (SELECT 1 AS table_type, NULL::DOUBLE AS z, z12_q1 FROM w UNION ALL SELECT 2, z, NULL FROM l) GROUP BY 1")
def zchange_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = D.changes(items(spark, sf_dir), METRICS, "task", "time")
    return D.changes_table(long, D.changes_wide(long, METRICS)).groupBy("table_type").agg(F.count("*").alias("n"), F.count("z").alias("z"), F.count("z12_q1").alias("z12_q1"))


@query(f"{ITEMS} SELECT subject_id, round_even(avg(q1), 3) AS m FROM items GROUP BY 1")
def rounded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rounded(items(spark, sf_dir).groupBy("subject_id").agg(F.avg("q1").alias("m")))


# --- previews ---

BEATS = f"WITH {V.SQL_BEATS}"


@query(f"{BEATS}, k AS (SELECT subject_id, quantile_cont(rr_ms, 0.01) AS lo, quantile_cont(rr_ms, 0.99) AS hi FROM beats GROUP BY 1) SELECT b.subject_id, seq, round(CASE WHEN hi > lo THEN (least(greatest(rr_ms, lo), hi) - lo) / (hi - lo + 1e-12) ELSE 0 END, 6) AS scaled FROM beats b JOIN k ON k.subject_id = b.subject_id")
def robust_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.robust_scaled(V.beats(spark, sf_dir), "rr_ms"), "scaled").select("subject_id", "seq", "scaled")


@query(f"{BEATS} SELECT subject_id, CAST(floor(t_s * 0.0001::DOUBLE) AS BIGINT) AS bin, round(median(rr_ms), 6) AS value FROM beats GROUP BY 1, 2")
def median_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.thinned(V.beats(spark, sf_dir), "rr_ms", 0.0001), "value")


@query(f"{BEATS}, b AS (SELECT subject_id, CAST(floor(t_s * 0.0001::DOUBLE) AS BIGINT) AS bin, median(rr_ms) AS value FROM beats GROUP BY 1, 2), g AS (SELECT subject_id, CAST(unnest(range(min(bin), max(bin) + 1)) AS BIGINT) AS bin FROM b GROUP BY 1) SELECT g.subject_id, g.bin, round(value, 6) AS value FROM g LEFT JOIN b ON b.subject_id = g.subject_id AND b.bin = g.bin")
def gap_preserving_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.thinned(V.beats(spark, sf_dir), "rr_ms", 0.0001, gaps=True), "value")


@query(f"{BEATS} SELECT subject_id, seq, round(avg(rr_ms) OVER (PARTITION BY subject_id ORDER BY t_s, seq ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS mean4, round(quantile_cont(rr_ms, 0.5) OVER (PARTITION BY subject_id ORDER BY t_s, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median5 FROM beats")
def rolling_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.smoothed(V.beats(spark, sf_dir), "rr_ms", 4).withColumnRenamed("smooth", "mean4")
    return rounded(P.smoothed(rows, "rr_ms", 5, "median"), "mean4", "smooth").select("subject_id", "seq", "mean4", F.col("smooth").alias("median5"))


@query(f"{BEATS} SELECT subject_id, CAST(floor(t_s - t0) AS BIGINT) AS second, round(median(60000 / rr_ms), 6) AS bpm FROM (SELECT *, min(t_s) OVER (PARTITION BY subject_id) AS t0 FROM beats) GROUP BY 1, 2")
def hr_1hz_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.rate_median(V.beats(spark, sf_dir)), "bpm")


SQL_FIGURES = "SELECT subject_id, count(*) AS n, round(median(rr_ms), 6) AS m, round(60000 / avg(rr_ms), 6) AS hr, round(sqrt(avg(d * d)), 6) AS rmssd FROM (SELECT *, rr_ms - lag(rr_ms) OVER (PARTITION BY subject_id ORDER BY t_s, seq) AS d FROM {t}) GROUP BY 1"


@query(f"""{BEATS}, k AS (SELECT *, rr_ms < 300 OR rr_ms > 2000 OR coalesce(abs(rr_ms - lag(rr_ms) OVER w) / lag(rr_ms) OVER w > 0.25, false) AS bad FROM beats WINDOW w AS (PARTITION BY subject_id ORDER BY t_s, seq)), a AS ({SQL_FIGURES.format(t='k')}), c AS ({SQL_FIGURES.format(t='(SELECT * FROM k WHERE NOT bad)')})
    SELECT a.subject_id, a.n AS n_all, a.m AS median_all, a.hr AS hr_all, a.rmssd AS rmssd_all, c.n AS n_clean, c.m AS median_clean, c.hr AS hr_clean, c.rmssd AS rmssd_clean FROM a LEFT JOIN c ON c.subject_id = a.subject_id""")
def zoom_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.quality(V.beats(spark, sf_dir))
    return rounded(found, *(f"{x}_{t}" for x in ("median", "hr", "rmssd") for t in ("all", "clean")))


@query(f"{SQL_CUT}, r AS (SELECT *, t_s - min(t_s) OVER (PARTITION BY subject_id, w_id) AS rel FROM cut), l AS (SELECT subject_id, w_id, max(rel) AS len FROM r GROUP BY 1, 2), o AS (SELECT subject_id, w_id, coalesce(sum(len + 20) OVER (PARTITION BY subject_id ORDER BY w_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l) SELECT r.subject_id, r.w_id, seq, round(rel + off, 3) AS x FROM r JOIN o ON o.subject_id = r.subject_id AND o.w_id = r.w_id")
def window_concat_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.one_axis(cut(spark, sf_dir)), "x", digits=3).select("subject_id", "w_id", "seq", "x")
