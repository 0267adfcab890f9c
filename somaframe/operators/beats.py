"""Beat series: rates, flags, comparison and choice of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somaframe.config import BeatRules, ScoreRules
from somaframe.functions.frames import SUBJECT, in_time
from somaframe.functions.selection import percentiles

RULES, SCORES = BeatRules(), ScoreRules()


def rate_track(beats: DataFrame, step: float = 1.0, full: bool = False) -> DataFrame:
    """Mean heart rate in steps from the subject's first beat: subject_id, second, bpm. full: empty steps too, as null."""
    t0 = F.min("t_s").over(Window.partitionBy(SUBJECT))
    placed = beats.withColumn("second", F.floor((F.col("t_s") - t0) / step))
    track = placed.where("rr_ms > 0").groupBy(SUBJECT, "second").agg(F.avg(60000.0 / F.col("rr_ms")).alias("bpm"))
    if not full:
        return track
    grid = placed.groupBy(SUBJECT).agg(F.max("second").alias("_most")).withColumn("second", F.explode(F.sequence(F.lit(0).cast("bigint"), "_most"))).drop("_most")
    return grid.join(track, [SUBJECT, "second"], "left")


def flags(beats: DataFrame, rules: BeatRules = RULES) -> DataFrame:
    """beats with `flagged`: a relative change above the threshold, or a heart rate out of bounds."""
    change = F.abs(F.col("rr_ms") / F.nullif(F.lag("rr_ms").over(in_time()), F.lit(0.0)) - 1) > rules.relative
    rate = F.try_divide(F.lit(60000.0), F.col("rr_ms"))
    return beats.withColumn("flagged", F.coalesce(change, F.lit(False)) | F.coalesce((rate < rules.least_bpm) | (rate > rules.most_bpm), F.lit(False)))


def overlap(first: DataFrame, second: DataFrame, least: float = SCORES.least_overlap) -> DataFrame:
    """subject_id, t0, t1 that two recordings share, if at least so many seconds."""
    a = first.groupBy(SUBJECT).agg(F.min("t_s").alias("a0"), F.max("t_s").alias("a1"))
    b = second.groupBy(SUBJECT).agg(F.min("t_s").alias("b0"), F.max("t_s").alias("b1"))
    both = a.join(b, SUBJECT).select(SUBJECT, F.greatest("a0", "b0").alias("t0"), F.least("a1", "b1").alias("t1"))
    return both.where(F.col("t1") - F.col("t0") >= least)


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mean absolute error and bias (first less second) of two rate tracks on the steps that both have."""
    a = first.select(SUBJECT, "second", F.col("bpm").alias("_a"))
    both = a.join(second.select(SUBJECT, "second", F.col("bpm").alias("_b")), [SUBJECT, "second"])
    d = F.col("_a") - F.col("_b")
    return both.groupBy(SUBJECT).agg(F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.count(d).alias("seconds"))


def score(flag_share: Column, mae: Column, bias: Column, rules: ScoreRules = SCORES) -> Column:
    """Higher is better; missing errors count as none."""
    error = F.least(F.coalesce(mae, F.lit(0.0)) / rules.most_error, F.lit(1.0))
    shift = F.least(F.abs(F.coalesce(bias, F.lit(0.0))) / rules.most_bias, F.lit(1.0))
    return rules.flags * (1 - F.coalesce(flag_share, F.lit(0.0))) + rules.error * (1 - error) + rules.bias * (1 - shift)


def decision_table(device: DataFrame, ecg: DataFrame, rules: BeatRules = RULES, scores: ScoreRules = SCORES) -> DataFrame:
    """One row for each subject with either source: figures of both, and the suggested choice."""
    shares = [flags(x, rules).groupBy(SUBJECT).agg(F.avg(F.col("flagged").cast("double")).alias(f"flags_{n}"), F.count("*").alias(f"beats_{n}")) for n, x in (("device", device), ("ecg", ecg))]
    table = shares[0].join(shares[1], SUBJECT, "full").join(agreement(rate_track(device), rate_track(ecg)), SUBJECT, "left")
    for n in ("device", "ecg"):
        table = table.withColumn(f"score_{n}", F.when(F.col(f"flags_{n}").isNotNull(), score(F.col(f"flags_{n}"), F.col("mae"), F.col("bias"), scores)))
    better = F.when(F.col("score_device").isNull(), "ecg_rr").when(F.col("score_ecg").isNull(), "device_rr")
    return table.withColumn("choice", F.coalesce(better, F.when(F.col("score_device") >= F.col("score_ecg"), "device_rr").otherwise("ecg_rr")))


def chosen(device: DataFrame, ecg: DataFrame, decisions: DataFrame) -> DataFrame:
    """Beats of the chosen source (decisions: subject_id, choice); a subject without a device series has its ECG's."""
    asked = decisions.select(SUBJECT, "choice")
    own = device.join(asked.where("choice = 'device_rr'"), SUBJECT, "left_semi").withColumn("source", F.lit("device_rr"))
    without = asked.where("choice = 'device_rr'").join(device.select(SUBJECT).distinct(), SUBJECT, "left_anti")
    other = ecg.join(asked.where("choice = 'ecg_rr'").unionByName(without), SUBJECT, "left_semi").withColumn("source", F.lit("ecg_rr"))
    return own.unionByName(other)


def cleaning_tasks(decisions: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """subject_id, choice: subjects for which a beat series is to be cleaned; only the allowed ones, if any are named."""
    wanted = [x.strip() for x in allowed if x.strip()]
    named = decisions.select(F.trim(F.col(SUBJECT).cast("string")).alias(SUBJECT), F.lower(F.trim("choice")).alias("choice"))
    tasks = named.where(F.col("choice").isin("device_rr", "ecg_rr") & (F.col(SUBJECT) != ""))
    return tasks.where(F.col(SUBJECT).isin(wanted)) if wanted else tasks


def not_cleaned(decisions: DataFrame, allowed: DataFrame) -> DataFrame:
    """Allowed subjects (column subject_id) without a task: no decision, or another choice."""
    wanted = allowed.select(F.trim(F.col(SUBJECT).cast("string")).alias(SUBJECT)).where(F.col(SUBJECT) != "").distinct()
    return wanted.join(cleaning_tasks(decisions), SUBJECT, "left_anti")


def activity(acc: DataFrame) -> DataFrame:
    """Mean absolute acceleration per second, scaled by its 5th and 95th percentile to 0 to 1; with under three
    seconds, unscaled. subject_id, second, activity."""
    size = F.sqrt(F.col("value_x") ** 2 + F.col("value_y") ** 2 + F.col("value_z") ** 2)
    each = acc.groupBy(SUBJECT, F.floor("time_s").alias("second")).agg(F.avg(F.abs(size)).alias("_v"))
    seconds = each.groupBy(SUBJECT).agg(F.count("_v").alias("_n"))
    known = seconds.join(percentiles(each, "_v", (0.05, 0.95), ("_lo", "_hi"), [SUBJECT]), SUBJECT, "left").withColumnRenamed(SUBJECT, "_s")
    scaled = F.least(F.greatest(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)), F.lit(1.0))
    joined = each.join(known, F.col(SUBJECT) == F.col("_s"))
    return joined.select(SUBJECT, "second", F.when(F.col("_n") < 3, F.col("_v")).otherwise(scaled).alias("activity"))
