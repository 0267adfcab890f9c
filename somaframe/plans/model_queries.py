"""Queries of mixed models over a balanced design, whose maximum likelihood has a closed form in SQL.

Subjects are suppliers, each with all three times (a line's number modulo 3) and two dependent variables, means of its lines. With every
subject at every time, cell means are plain means, the residual variance is what is left within subjects, and the variance of
subjects' means gives the rest.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from somaframe.operators import mixed_model as M
from somaframe.plans.registry import query
from somaframe.sources import sample_views as V

VALUES = ("y1", "y2")


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject_id"), (F.col("l_suppkey") % 2).cast("int").alias("task"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("time"), "l_quantity", "l_discount")
    return lines.groupBy("subject_id", "task", "time").agg((F.avg("l_quantity") + F.first(F.col("subject_id") % 7) * 2).alias("y1"), (F.avg("l_discount") * 1000 + F.first(F.col("subject_id") % 5) * F.first("time")).alias("y2"))


#: Per variable (dv): subjects of each condition (n0, n1), cell means, the residual variance s2 and that between subjects t2.
SQL_MODEL = """lo AS (SELECT l_suppkey AS subject_id, CAST(l_suppkey % 2 AS INTEGER) AS task, CAST(l_linenumber % 3 + 1 AS INTEGER) AS time, avg(l_quantity) + any_value(l_suppkey % 7) * 2 AS y1, avg(l_discount) * 1000 + any_value(l_suppkey % 5) * any_value(l_linenumber % 3 + 1) AS y2 FROM lineitem GROUP BY 1, 2, 3),
    lg AS (SELECT subject_id, task, time, 'y1' AS dv, y1 AS y FROM lo UNION ALL SELECT subject_id, task, time, 'y2', y2 FROM lo),
    ce AS (SELECT dv, task, time, avg(y) AS m, count(*) AS n FROM lg GROUP BY 1, 2, 3), co AS (SELECT dv, task, avg(m) AS m FROM ce GROUP BY 1, 2),
    su AS (SELECT dv, task, subject_id, avg(y) AS m FROM lg GROUP BY 1, 2, 3),
    sw AS (SELECT lg.dv, sum((y - su.m - ce.m + co.m) ** 2) AS ssw FROM lg JOIN su ON su.dv = lg.dv AND su.subject_id = lg.subject_id JOIN ce ON ce.dv = lg.dv AND ce.task = lg.task AND ce.time = lg.time JOIN co ON co.dv = lg.dv AND co.task = lg.task GROUP BY 1),
    sb AS (SELECT su.dv, sum((su.m - co.m) ** 2) AS ssb, count(*) AS n, count(*) FILTER (WHERE su.task = 0) AS n0, count(*) FILTER (WHERE su.task = 1) AS n1 FROM su JOIN co ON co.dv = su.dv AND co.task = su.task GROUP BY 1),
    va AS (SELECT sb.dv, n, n0, n1, ssw / (2 * n) AS s2, 3 * ssb / n AS big, (3 * ssb / n - ssw / (2 * n)) / 3 AS t2 FROM sb JOIN sw ON sw.dv = sb.dv),
    cm AS (SELECT dv, max(m) FILTER (WHERE task = 0 AND time = 1) AS a1, max(m) FILTER (WHERE task = 0 AND time = 2) AS a2, max(m) FILTER (WHERE task = 0 AND time = 3) AS a3,
        max(m) FILTER (WHERE task = 1 AND time = 1) AS b1, max(m) FILTER (WHERE task = 1 AND time = 2) AS b2, max(m) FILTER (WHERE task = 1 AND time = 3) AS b3 FROM ce GROUP BY 1),
    v AS (SELECT va.*, a1, a2, a3, b1, b2, b3, 1.0::DOUBLE / n0 + 1.0::DOUBLE / n1 AS inv FROM va JOIN cm ON cm.dv = va.dv)"""
#: The two-sided tail of a normal, by Simpson's rule over 2,000 steps.
TAIL = "greatest(0, 1 - sqrt(2 / pi()) * abs({z}) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: exp(-0.5 * (abs({z}) * i / 2000) ** 2) * CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)))"
Q = 1.959963984540054


def sql_tests(rows: list[tuple[str, str, str, str]], more: str = "") -> str:
    """Name, estimate, variance and further columns of each row, with what a test of it gives."""
    parts = " UNION ALL ".join(f"SELECT dv, '{name}' AS name, {estimate} AS e, {variance} AS va{extra} FROM v" for name, estimate, variance, extra in rows)
    tail = TAIL.format(z="e / sqrt(va)")
    return f"""WITH {SQL_MODEL}, t AS ({parts}), u AS (SELECT *, {tail} AS p0 FROM t) SELECT dv, name, round(e, 4) AS estimate, round(sqrt(va), 4) AS se, round(e / sqrt(va), 4) AS z, round(p0, 4) AS p, round(e - {Q} * sqrt(va), 4) AS low, round(e + {Q} * sqrt(va), 4) AS high{more} FROM u"""


def told(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Result tables of the study, both variables from one aggregation."""
    tables = M.all_tables(balanced(spark, sf_dir), VALUES, (), "task", "time")
    return spark.createDataFrame(pd.concat([tables[n].assign(part=n) for n in names], ignore_index=True))


def shown(found: DataFrame, *more: str | Column) -> DataFrame:
    digits = {"estimate": 4, "se": 4, "z": 4, "p": 4, "low": 4, "high": 4, "p_bonferroni": 4}
    return found.select("dv", "name", *(F.round(c, digits[c]).alias(c) if isinstance(c, str) and c in digits else F.col(c) if isinstance(c, str) else c for c in ("estimate", "se", "z", "p", "low", "high", *more)))


@query(f"WITH {SQL_MODEL}, l AS (SELECT *, -0.5 * (2 * n * ln(2 * pi() * s2) + n * ln(2 * pi() * big) + 3 * n) AS ll FROM v) SELECT dv, 3 * n AS n_obs, n AS n_groups, round(ll, 4) AS loglik, round(16 - 2 * ll, 4) AS aic, round(8 * ln(3 * n) - 2 * ll, 4) AS bic, round(t2, 4) AS var_between, round(s2, 4) AS var_residual FROM l")
def lmm_balanced_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = told(spark, sf_dir, "model_fit")
    return found.select("dv", "n_obs", "n_groups", *(F.round(c, 4).alias(c) for c in ("loglik", "aic", "bic", "var_between", "var_residual")))


@query(sql_tests([
    ("Intercept", "a1", "(s2 + t2) / n0", ""), ("condition[1]", "b1 - a1", "(s2 + t2) * inv", ""), *((f"time[{t}]", f"a{t} - a1", "2 * s2 / n0", "") for t in (2, 3)), *((f"condition[1]:time[{t}]", f"b{t} - b1 - a{t} + a1", "2 * s2 * inv", "") for t in (2, 3)),
]))
def lmm_balanced_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(told(spark, sf_dir, "fixed_effects"))


@query(f"""WITH {SQL_MODEL}, x AS (SELECT dv, 'condition' AS term, (b1 - a1) ** 2 / ((s2 + t2) * inv) AS chi2, 1 AS df FROM v
    UNION ALL SELECT dv, 'time', (2 * (a2 - a1) ** 2 - 2 * (a2 - a1) * (a3 - a1) + 2 * (a3 - a1) ** 2) / 3 * n0 / s2, 2 FROM v
    UNION ALL SELECT dv, 'condition:time', (2 * (b2 - b1 - a2 + a1) ** 2 - 2 * (b2 - b1 - a2 + a1) * (b3 - b1 - a3 + a1) + 2 * (b3 - b1 - a3 + a1) ** 2) / 3 / (s2 * inv), 2 FROM v)
    SELECT dv, term, round(chi2, 4) AS chi2, df::BIGINT AS df, round(CASE df WHEN 2 THEN exp(-chi2 / 2) ELSE {TAIL.format(z='sqrt(chi2)')} END, 4) AS p FROM x""")
def lmm_balanced_wald(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir, "type3").select("dv", "term", F.round("chi2", 4).alias("chi2"), "df", F.round("p", 4).alias("p"))


@query(sql_tests([(str(c), f"({x}1 + {x}2 + {x}3) / 3", f"(t2 + s2 / 3) / n{c}", ", 'emmeans_condition' AS part") for c, x in ((0, "a"), (1, "b"))] + [(str(t), f"(a{t} + b{t}) / 2", "(s2 + t2) * inv / 4", ", 'emmeans_time' AS part") for t in (1, 2, 3)], ", part"))
def lmm_balanced_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(told(spark, sf_dir, "emmeans_condition", "emmeans_time"), "part")


PAIRS = ((1, 2), (1, 3), (2, 3))


@query(sql_tests([("1 - 0", "(b1 + b2 + b3 - a1 - a2 - a3) / 3", "(t2 + s2 / 3) * inv", ", 1 AS pairs, 'pairs_condition' AS part")] + [(f"{u} - {t}", f"(a{u} + b{u} - a{t} - b{t}) / 2", "2 * s2 * inv / 4", ", 3 AS pairs, 'pairs_time' AS part") for t, u in PAIRS], ", part, round(least(1, p0 * pairs), 4) AS p_bonferroni"))
def lmm_balanced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(told(spark, sf_dir, "pairs_condition", "pairs_time"), "part", "p_bonferroni")


@query(sql_tests([("1 - 0", f"b{t} - a{t}", "(s2 + t2) * inv", f", 1 AS pairs, '{t}' AS level, 'condition_by_time' AS part") for t in (1, 2, 3)] + [(f"{u} - {t}", f"{x}{u} - {x}{t}", f"2 * s2 / n{c}", f", 3 AS pairs, '{c}' AS level, 'time_by_condition' AS part") for c, x in ((0, "a"), (1, "b")) for t, u in PAIRS], ", part, level, round(least(1, p0 * pairs), 4) AS p_bonferroni"))
def lmm_balanced_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(told(spark, sf_dir, "condition_by_time", "time_by_condition"), "part", F.col("at").alias("level"), "p_bonferroni")
