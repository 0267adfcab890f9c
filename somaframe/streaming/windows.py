"""Tumbling windows over a stream of beats, with late data: the streaming form of windows without a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_features(beats: DataFrame, length: str = "5 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """subject_id, t_start, t_end, n, hr_bpm, sdnn_ms of a stream (or a table) of beats (subject_id, rr_ms and a
    timestamp). Beats that come later than `late` after the newest are dropped by the watermark; state is one row
    for each subject and open window."""
    rows = beats.withWatermark(time, late).groupBy(F.window(time, length), "subject_id")
    found = rows.agg(F.count("*").alias("n"), F.try_divide(F.lit(60000.0), F.avg("rr_ms")).alias("hr_bpm"), F.stddev_samp("rr_ms").alias("sdnn_ms"))
    return found.select("subject_id", F.col("window.start").alias("t_start"), F.col("window.end").alias("t_end"), "n", "hr_bpm", "sdnn_ms")
