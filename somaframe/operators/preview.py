"""The data behind previews: scaled, thinned and smoothed tracks, and windows laid on one axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somaframe.functions.frames import SUBJECT, centred, in_time, median
from somaframe.functions.selection import percentiles


def robust_scaled(rows: DataFrame, value: str, keys: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """rows with `scaled`: cut at the 1st and 99th percentile, then 0 to 1; constant series give zeros."""
    known = percentiles(rows, value, (0.01, 0.99), ("_lo", "_hi"), keys)
    known = rows.select(*keys).distinct().join(known, list(keys), "left").withColumnsRenamed({k: f"_{k}" for k in keys})
    cut = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (cut - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-12)).when(F.col(value).isNotNull(), 0.0)
    return rows.join(known, [F.col(k) == F.col(f"_{k}") for k in keys]).withColumn("scaled", scaled).drop(*(f"_{k}" for k in keys), "_lo", "_hi")


def thinned(rows: DataFrame, value: str, hz: float, time: str = "t_s", gaps: bool = False, keys: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """keys, bin, value: medians of bins of 1 / hz seconds; with gaps, empty bins between are there as null."""
    binned = rows.groupBy(*keys, F.floor(F.col(time) * hz).alias("bin")).agg(median(value).alias("value"))
    if not gaps:
        return binned
    span = binned.groupBy(*keys).agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("bin")).join(binned, [*keys, "bin"], "left")


def smoothed(rows: DataFrame, value: str, n: int, kind: str = "mean", keep_gaps: bool = False) -> DataFrame:
    """rows with `smooth`, a centred rolling mean or median over what is there; keep_gaps leaves missing rows missing."""
    frame = centred(in_time(), n)
    found = F.avg(value).over(frame) if kind == "mean" else median(value).over(frame)
    return rows.withColumn("smooth", F.when(F.col(value).isNotNull(), found) if keep_gaps else found)


def rate_median(beats: DataFrame) -> DataFrame:
    """subject_id, second, bpm: median heart rate per second from the first beat."""
    t0 = F.min("t_s").over(Window.partitionBy(SUBJECT))
    return beats.where("rr_ms > 0").withColumn("second", F.floor(F.col("t_s") - t0)).groupBy(SUBJECT, "second").agg(median(60000.0 / F.col("rr_ms")).alias("bpm"))


def quality(beats: DataFrame) -> DataFrame:
    """Per subject: rows, suspicious ones, and median, heart rate and RMSSD of all and of the clean beats."""
    order = in_time()
    jump = F.abs(F.col("rr_ms") - F.lag("rr_ms").over(order)) / F.lag("rr_ms").over(order) > 0.25
    marked = beats.withColumn("_bad", (F.col("rr_ms") < 300) | (F.col("rr_ms") > 2000) | F.coalesce(jump, F.lit(False)))

    def figures(rows: DataFrame, tag: str) -> DataFrame:
        d = rows.withColumn("_d", F.col("rr_ms") - F.lag("rr_ms").over(order))
        return d.groupBy(SUBJECT).agg(F.count("*").alias(f"n_{tag}"), median("rr_ms").alias(f"median_{tag}"), F.try_divide(F.lit(60000.0), F.avg("rr_ms")).alias(f"hr_{tag}"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias(f"rmssd_{tag}"))

    return figures(marked, "all").join(figures(marked.where("NOT _bad"), "clean"), SUBJECT, "left")


def one_axis(cut: DataFrame, gap: float = 20.0, time: str = "t_s") -> DataFrame:
    """cut (rows in windows) with `x`: seconds along all windows of a subject laid end to end, `gap` apart."""
    rel = F.col(time) - F.min(time).over(Window.partitionBy(SUBJECT, "w_id"))
    rows = cut.withColumn("_rel", rel)
    lengths = rows.groupBy(SUBJECT, "w_id").agg(F.max("_rel").alias("_len"))
    order = Window.partitionBy(SUBJECT).orderBy("w_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.withColumn("_offset", F.coalesce(F.sum(F.col("_len") + gap).over(order), F.lit(0.0))).drop("_len")
    return rows.join(offsets, [SUBJECT, "w_id"]).withColumn("x", F.col("_rel") + F.col("_offset")).drop("_rel", "_offset")
