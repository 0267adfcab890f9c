"""Descriptive statistics, variance decomposition, slopes, histograms, regressions and standardised changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somaframe.functions.folders import checkpoint
from somaframe.functions.frames import SUBJECT
from somaframe.functions.selection import percentiles

#: Up to so many groups, a row of two numbers each goes to every task.
FEW_GROUPS = 10_000


def described(rows: DataFrame, value: str, keys: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """keys, mean, std (0 for a single value), count, cv."""
    n = F.count(value)
    found = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.when(n <= 1, 0.0).otherwise(F.stddev_samp(value)).alias("std"), n.alias("count"))
    return found.withColumn("cv", F.try_divide("std", "mean"))


def influence(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each subject's part in the variance between subjects, within each group of `by` or over all: n, mean,
    between_ss, share_between, share_total, z."""
    rows = rows.where(F.col(value).isNotNull())
    each = rows.groupBy(*by, SUBJECT).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    overall = each.groupBy(*(F.col(b).alias(f"_by{i}") for i, b in enumerate(by))).agg(
        (F.sum("_s") / F.sum("n")).alias("_grand"), (F.sum("_q") - F.sum("_s") * F.sum("_s") / F.sum("n")).alias("_total"), F.avg("mean").alias("_mm"), F.stddev_samp("mean").alias("_ms"),
        (F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.sum("_s") * F.sum("_s") / F.sum("n")).alias("_between"),
    )
    joined = each.join(overall, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]) if by else each.crossJoin(F.broadcast(overall))
    ss = F.col("n") * (F.col("mean") - F.col("_grand")) ** 2
    return joined.select(*by, SUBJECT, "n", "mean", ss.alias("between_ss"), F.try_divide(ss, F.col("_between")).alias("share_between"), F.try_divide(ss, F.col("_total")).alias("share_total"), F.try_divide(F.col("mean") - F.col("_mm"), F.col("_ms")).alias("z"))


def slopes(rows: DataFrame, value: str, times: Sequence[int], condition: str, time: str = "t_id") -> DataFrame:
    """Per subject: the change of its mean between adjacent times over their distance (sl_ab), its condition's mean
    of that (grp_sl_ab) and the difference (d_sl_ab)."""
    cells = rows.groupBy(SUBJECT, condition).agg(*(F.avg(F.when(F.col(time) == t, F.col(value))).alias(f"_v{t}") for t in times))
    own = Window.partitionBy(condition)
    out = cells
    for a, b in zip(times, times[1:], strict=False):
        out = out.withColumn(f"sl_{a}{b}", (F.col(f"_v{b}") - F.col(f"_v{a}")) / (b - a))
        out = out.withColumn(f"grp_sl_{a}{b}", F.avg(f"sl_{a}{b}").over(own)).withColumn(f"d_sl_{a}{b}", F.col(f"sl_{a}{b}") - F.col(f"grp_sl_{a}{b}"))
    return out.drop(*(f"_v{t}" for t in times))


def trajectories(rows: DataFrame, value: str, condition: str, time: str = "t_id") -> DataFrame:
    """Means of subjects' means per time, over all (condition null) and per condition, in one pass."""
    each = rows.groupBy(condition, SUBJECT, time).agg(F.avg(value).alias("_m"))
    sets = each.groupingSets([[F.col(time)], [F.col(condition), F.col(time)]], condition, time)
    return sets.agg(F.avg("_m").alias("mean"), F.count("_m").alias("n"), F.grouping(condition).alias("overall"))


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """All fractional columns rounded, half to even."""
    return df.withColumns({c: F.bround(c, digits) for c, kind in df.dtypes if kind in ("double", "float")})


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column: count, mean, std, min, exact quartiles, max."""
    narrow = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("_x")).select("_x.*")
    figures = narrow.groupBy("name").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    quartiles = percentiles(narrow, "v", (0.25, 0.5, 0.75), ("q25", "q50", "q75"), ["name"])
    return figures.join(quartiles, "name", "left").select("name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(rows: DataFrame, value: str, group: str, bins: int = 10) -> DataFrame:
    """group, bin (from 0), n: equal bins over all groups, the top edge in the last."""
    edges = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(bins - 1))
    return rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(group, F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def line(rows: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """by, slope, intercept"""
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def plane(rows: DataFrame, y: str, x: str, z: str, by: Sequence[str]) -> DataFrame:
    """by, n, b0, b1 (of x), b2 (of z): least squares with a covariate, from moments; three complete rows at least."""
    whole = rows.dropna(subset=[y, x, z])
    m = whole.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"_{k}") for c, k in ((y, "y"), (x, "x"), (z, "z"))), F.covar_samp(x, y).alias("_xy"), F.covar_samp(z, y).alias("_zy"), F.covar_samp(x, z).alias("_xz"),
        F.var_samp(x).alias("_xx"), F.var_samp(z).alias("_zz"),
    )
    det = F.col("_xx") * F.col("_zz") - F.col("_xz") ** 2
    b1 = F.try_divide(F.col("_xy") * F.col("_zz") - F.col("_zy") * F.col("_xz"), det)
    b2 = F.try_divide(F.col("_zy") * F.col("_xx") - F.col("_xy") * F.col("_xz"), det)
    return m.where("n >= 3").select(*by, "n", (F.col("_y") - b1 * F.col("_x") - b2 * F.col("_z")).alias("b0"), b1.alias("b1"), b2.alias("b2"))


def adjusted(rows: DataFrame, y: str, x: str, z: str, by: Sequence[str]) -> DataFrame:
    """rows with {y}_adj: y less what the covariate z adds to it, against z's mean in the group."""
    fit = checkpoint(plane(rows, y, x, z, by).select(*by, "b2").join(rows.dropna(subset=[y, x, z]).groupBy(*by).agg(F.avg(z).alias("_mz")), list(by)))
    # few groups with many rows each would be few tasks' work in a shuffled join; counted first, they go to every task
    few = fit.count() <= FEW_GROUPS
    return rows.join(F.broadcast(fit) if few else fit, list(by)).withColumn(f"{y}_adj", F.col(y) - F.col("b2") * (F.col(z) - F.col("_mz"))).drop("b2", "_mz")


def without(rows: DataFrame, ids: Sequence[str], subject: Column, short: Column) -> DataFrame:
    """Rows whose full and short ids are not among ids."""
    return rows.where(~subject.isin(*ids) & ~short.isin(*ids)) if ids else rows


def group_deviation(rows: DataFrame, value: str, times: Sequence[int], condition: str = "task", time: str = "t_id") -> DataFrame:
    """condition, sd_{t}: each group's deviation at a time; null for under two values."""
    return rows.groupBy(condition).agg(*(F.stddev_samp(F.when(F.col(time) == t, F.col(value))).alias(f"sd_{t}") for t in times))


def changes(rows: DataFrame, metrics: dict[str, int], condition: str = "task", time: str = "t_id") -> DataFrame:
    """subject, condition, indicator (the metric's code), time (1, 2), z: changes from time 1 to 2 and 2 to 3 in units of
    the group's deviation at the earlier one. Subjects without any value of a metric are left out for it."""
    at = rows.where(F.col(condition).isNotNull()).groupBy(SUBJECT, condition).agg(*(F.avg(F.when(F.col(time) == t, F.col(m))).alias(f"{m}/{t}") for m in metrics for t in (1, 2, 3)))
    sds = rows.groupBy(F.col(condition).alias("_c")).agg(*(F.stddev_samp(F.when(F.col(time) == t, F.col(m))).alias(f"{m}/sd{t}") for m in metrics for t in (1, 2)))
    joined = at.join(sds, F.col(condition) == F.col("_c"))
    cell = lambda m, a, b: F.when(F.col(f"`{m}/sd{a}`") > 0, (F.col(f"`{m}/{b}`") - F.col(f"`{m}/{a}`")) / F.col(f"`{m}/sd{a}`"))
    any_ = lambda m: F.coalesce(*(F.col(f"`{m}/{t}`") for t in (1, 2, 3))).isNotNull()
    entries = [F.struct(F.lit(code).alias("indicator"), F.lit(k).alias("time"), cell(m, k, k + 1).alias("z"), any_(m).alias("_any")) for m, code in metrics.items() for k in (1, 2)]
    return joined.select(SUBJECT, condition, F.explode(F.array(*entries)).alias("_e")).where("_e._any").select(SUBJECT, condition, "_e.indicator", "_e.time", "_e.z")


def with_covariates(changes: DataFrame, rows: DataFrame, within: Sequence[str] = (), between: Sequence[str] = (), time: str = "t_id") -> DataFrame:
    """Changes (long) with covariates: those that vary within subjects at the later time of the change (from 1 to 2 at 2,
    from 2 to 3 at 3), those between subjects as each subject's first value in time."""
    at = rows.where(F.col(time).isin(2, 3)).groupBy(F.col(SUBJECT).alias("_s"), F.col(time).alias("_t")).agg(*(F.min(c).alias(c) for c in within))
    own = rows.groupBy(F.col(SUBJECT).alias("_o")).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(time, c))).alias(c) for c in between))
    out = changes
    if within:
        out = out.join(at, (F.col(SUBJECT) == F.col("_s")) & (changes["time"] + 1 == F.col("_t")), "left").drop("_s", "_t")
    if between:
        out = out.join(own, F.col(SUBJECT) == F.col("_o"), "left").drop("_o")
    return out


def changes_wide(long: DataFrame, metrics: dict[str, int], condition: str = "task") -> DataFrame:
    """One row per subject: z12_{metric} and z23_{metric}."""
    cells = [F.max(F.when((F.col("indicator") == code) & (F.col("time") == k), F.col("z"))).alias(f"z{k}{k + 1}_{m}") for m, code in metrics.items() for k in (1, 2)]
    return long.groupBy(SUBJECT, condition).agg(*cells)


def changes_table(long: DataFrame, wide: DataFrame) -> DataFrame:
    """Both forms below each other: table_type 1 the wide, 2 the long."""
    return wide.withColumn("table_type", F.lit(1)).unionByName(long.withColumn("table_type", F.lit(2)), allowMissingColumns=True)
