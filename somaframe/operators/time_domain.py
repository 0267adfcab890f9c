"""Per-window features in the time domain, quality figures, acceleration and centring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somaframe.functions.frames import SUBJECT, median
from somaframe.functions.selection import percentiles

KEY = [SUBJECT, "w_id"]


def differences(cut: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """cut with `d`, each beat less the one before in its window, and `gap`, the time between them."""
    order = Window.partitionBy(*keys).orderBy("t_s", "seq")
    return cut.withColumns({"d": F.col("rr_ms") - F.lag("rr_ms").over(order), "gap": F.col("t_s") - F.lag("t_s").over(order)})


def hr() -> Column:
    return F.try_divide(F.lit(60000.0), F.avg("rr_ms"))


def rmssd() -> Column:
    return F.sqrt(F.avg(F.col("d") * F.col("d")))


def sdnn() -> Column:
    return F.stddev_samp("rr_ms")


def pnn(limit: float = 50.0) -> Column:
    return 100 * F.avg(F.when(F.abs("d") > limit, 1.0).when(F.col("d").isNotNull(), 0.0))


def sd1() -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.var_samp("d") / 2))


def sd2() -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 * F.var_samp("rr_ms") - F.var_samp("d") / 2))


#: Feature name to its aggregate; what is not asked for is never computed.
FEATURES = {"hr_bpm": hr, "rmssd_ms": rmssd, "sdnn_ms": sdnn, "pnn50_pct": pnn, "sd1_ms": sd1, "sd2_ms": sd2}


def features(cut: DataFrame, wanted: Sequence[str] = tuple(FEATURES), keys: Sequence[str] = KEY) -> DataFrame:
    """keys and the wanted features of beats cut into windows."""
    return differences(cut, keys).groupBy(*keys).agg(*(FEATURES[w]().alias(w) for w in wanted))


def measured_rate(features: DataFrame, hr: DataFrame, windows: DataFrame) -> DataFrame:
    """features with hr_bpm from a device's own heart rate wherever the window has any."""
    own = hr.select(F.col(SUBJECT).alias("_s"), F.col("t_s").alias("_t"), "bpm")
    inside = (F.col(SUBJECT) == F.col("_s")) & (F.col("_t") >= F.col("t_start_s")) & (F.col("_t") < F.col("t_end_s"))
    means = windows.select(*KEY, "t_start_s", "t_end_s").join(own, inside).groupBy(*KEY).agg(F.avg("bpm").alias("_bpm"))
    return features.join(means, KEY, "left").withColumn("hr_bpm", F.coalesce("_bpm", "hr_bpm")).drop("_bpm")


def quality(cut: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """rr_valid_ratio, the share of the window that its beats fill, and rr_max_gap_s."""
    length = F.first(F.col("t_end_s") - F.col("t_start_s"))
    filled = F.least(F.greatest(F.sum("rr_ms") / 1000, F.lit(0.0)), length)
    return differences(cut, keys).groupBy(*keys).agg(F.bround(F.try_divide(filled, length), 3).alias("rr_valid_ratio"), F.bround(F.max("gap"), 3).alias("rr_max_gap_s"))


def centred(table: DataFrame, columns: Sequence[str], means: bool = True) -> DataFrame:
    """table with x_ws (less the subject's mean) and, if asked for, x_bs (that mean)."""
    own = Window.partitionBy(SUBJECT)
    added = {f"{c}_ws": F.col(c) - F.avg(c).over(own) for c in columns}
    if means:
        added |= {f"{c}_bs": F.avg(c).over(own) for c in columns}
    return table.withColumns(added)


def magnitude(x: str = "value_x", y: str = "value_y", z: str | None = "value_z") -> Column:
    """Length of the acceleration; two axes suffice where there is no third."""
    return F.sqrt(F.col(x) ** 2 + F.col(y) ** 2 + (F.col(z) ** 2 if z else F.lit(0.0)))


def enmo(cut: DataFrame, baseline: int = 1, quantile: float = 0.20) -> DataFrame:
    """subject_id, w_id, acc_enmo_mean: mean acceleration above rest. Rest is the median of the lowest fifth of
    magnitudes in the baseline window (of all, if that is under max(10, 5 %) rows), else in the own window."""
    sized = cut.select(*KEY, magnitude().alias("vm")).where("vm IS NOT NULL")
    edge = sized.groupBy(*KEY).agg(F.percentile("vm", F.lit(quantile)).alias("_q"), F.count("*").alias("_n"), median("vm").alias("_all"))
    low = sized.join(edge, KEY).groupBy(*KEY).agg(
        median(F.when(F.col("vm") <= F.col("_q"), F.col("vm"))).alias("_low"), F.count_if(F.col("vm") <= F.col("_q")).alias("_k"), F.first("_n").alias("_n"), F.first("_all").alias("_all")
    )
    rest = low.select(*KEY, F.when(F.col("_k") < F.greatest(F.lit(10.0), 0.05 * F.col("_n")), F.col("_all")).otherwise(F.col("_low")).alias("_own"))
    base = rest.where(F.col("w_id") == baseline).select(SUBJECT, F.col("_own").alias("_base"))
    g0 = rest.join(base, SUBJECT, "left").select(*KEY, F.coalesce("_base", "_own").alias("g0"))
    return sized.join(g0, KEY).groupBy(*KEY).agg(F.avg(F.greatest(F.col("vm") - F.col("g0"), F.lit(0.0))).alias("acc_enmo_mean"))


def motion(acc: DataFrame, threshold: float) -> DataFrame:
    """Diagnostics of a recording: share of rows whose magnitude is above its median by a threshold, the unit that
    the median suggests, distinct rounded values, and the spread of sampling steps."""
    order = Window.partitionBy(SUBJECT).orderBy("time_s")
    own = acc.select(SUBJECT, magnitude().alias("vm"), "value_x", (F.col("time_s") - F.lag("time_s").over(order)).alias("dt"))
    centre = own.groupBy(SUBJECT).agg(F.stddev_samp("dt").alias("jitter"), F.count_distinct(F.round("value_x", 6)).alias("distinct_x"))
    for name in ("vm", "dt"):
        centre = centre.join(percentiles(own, name, (0.5,), (f"median_{name}",), [SUBJECT]), SUBJECT, "left")
    share = own.join(centre.select(SUBJECT, "median_vm"), SUBJECT).groupBy(SUBJECT).agg(F.avg(F.when(F.col("vm") - F.col("median_vm") > threshold, 1.0).otherwise(0.0)).alias("motion_frac"))
    unit = F.when(F.col("median_vm") > 100, "mg").when(F.col("median_vm") > 5, "m/s2").otherwise("g")
    return centre.join(share, SUBJECT).withColumn("unit", unit)


def assembled(index: DataFrame, families: Sequence[DataFrame], wanted: Sequence[str]) -> DataFrame:
    """One row for each window of the first family (beats) that the index knows; other families are optional,
    wanted columns that none has are null."""
    out = index.join(families[0], KEY)
    for one in families[1:]:
        out = out.join(one, KEY, "left")
    return out.select(*(c for c in index.columns), *(F.col(w) if w in out.columns else F.lit(None).cast("double").alias(w) for w in wanted))
