"""Normalising raw tables: time units, canonical schemas, validation, and choice among sources."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import get_close_matches

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somaframe.functions.frames import finite, median
from somaframe.functions.names import blank_to_null

#: Canonical columns of each kind of signal: time first.
CANONICAL = {
    "rr": ("t_s", "rr_ms"), "ppi": ("t_s", "rr_ms"), "hr": ("t_s", "bpm"), "ecg": ("time_s", "value"), "resp": ("time_s", "value"),
    "ppg": ("t_s", "value"), "acc": ("time_s", "value_x", "value_y", "value_z"), "events": ("time_s", "events"),
}


def number(value: Column) -> Column:
    """A finite double, or null."""
    return finite(blank_to_null(value.cast("string")).try_cast("double"))


def in_seconds(series: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """series with time in seconds. The unit of each series follows from its typical step and size: steps from
    100,000 are microseconds, steps from 10 with values under 100,000 are milliseconds; under three points nothing changes."""
    order = Window.partitionBy(*keys).orderBy(time)
    coerced = series.withColumn(time, number(F.col(time))).where(F.col(time).isNotNull())
    step = coerced.withColumn("_d", F.abs(F.nullif(F.col(time) - F.lag(time).over(order), F.lit(0.0))))
    known = step.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(median("_d").alias("_dt"), F.max(time).alias("_max"), median(time).alias("_med"), F.count("*").alias("_n"))
    divisor = F.when((F.col("_n") < 3) | F.col("_dt").isNull(), 1.0).when(F.col("_dt") >= 1e5, 1e6).when((F.col("_dt") >= 10) & (F.col("_max") < 1e5) & (F.col("_med") < 1e5), 1000.0).otherwise(1.0)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return coerced.join(known, same).withColumn(time, F.col(time) / divisor).select(*series.columns)


def beat_unit(rr: Column) -> Column:
    """Beat intervals under ten are seconds."""
    return F.when(rr < 10, rr * 1000).otherwise(rr)


def first_two_numeric(df: DataFrame) -> tuple[str, str]:
    """Time and value by position: the first two numeric columns, else the first two. Reads the schema only."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return tuple((numeric if len(numeric) > 1 else df.columns * 2)[:2])


def suggested(columns: Sequence[str], missing: str) -> list[str]:
    """Columns whose names are like a missing one's."""
    return get_close_matches(missing, columns, n=5, cutoff=0.55)


def standard(df: DataFrame, signal: str, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Columns keys and the canonical ones of a signal, values coerced, incomplete rows dropped."""
    if signal not in CANONICAL:
        raise ValueError(f"unknown signal {signal}")
    names = CANONICAL[signal]
    if signal == "acc":
        low = {c.lower(): c for c in df.columns}
        source = ["time_s" if "time_s" in df.columns else first_two_numeric(df)[0], *(low.get(f"{a}_mg", f"value_{a}") for a in "xyz")]
        out = df.select(*keys, *(number(F.col(s)).alias(n) for s, n in zip(source, names, strict=True)))
        return out.dropna(subset=["time_s"])
    if signal == "events":
        source = [c for c in df.columns if c not in keys][:2]
        return df.select(*keys, number(F.col(source[0])).alias("time_s"), F.trim(F.col(source[1]).cast("string")).alias("events")).dropna()
    source = names if set(names) <= set(df.columns) else first_two_numeric(df.drop(*keys))
    value = number(F.col(source[1]))
    out = df.select(*keys, number(F.col(source[0])).alias(names[0]), (beat_unit(value) if signal in ("rr", "ppi") else value).alias(names[1]), *(["fs_hz"] if "fs_hz" in df.columns else []))
    return out.dropna(subset=list(names))


def strictly_increasing(series: DataFrame, keys: Sequence[str], time: str = "t_s", tie: str = "seq") -> DataFrame:
    """series without rows at the time of the row before (the first stays)."""
    order = Window.partitionBy(*keys).orderBy(time, tie)
    step = F.col(time) - F.lag(time).over(order)
    return series.dropna(subset=[time]).withColumn("_d", step).where("_d IS NULL OR _d <> 0").drop("_d")


def invalid_series(series: DataFrame, keys: Sequence[str], time: str = "t_s", tie: str = "seq", least: int = 3) -> DataFrame:
    """keys and fault of series with too few rows, or whose time in the order of `tie` goes back."""
    order = Window.partitionBy(*keys).orderBy(tie)
    step = series.withColumn("_d", F.col(time) - F.lag(time).over(order))
    counts = step.groupBy(*keys).agg(F.count(time).alias("_n"), F.count_if(F.col("_d") < 0).alias("_back"))
    fault = F.when(F.col("_n") < least, "too short").when(F.col("_back") > 0, "decreasing")
    return counts.select(*keys, fault.alias("fault")).where("fault IS NOT NULL")


def sample_rate(series: DataFrame, keys: Sequence[str], time: str = "t_s", given: str | None = None) -> DataFrame:
    """keys, fs_hz: the first given rate, else one over the median step."""
    order = Window.partitionBy(*keys).orderBy(time)
    step = series.withColumn("_d", F.nullif(F.col(time) - F.lag(time).over(order), F.lit(0.0)))
    rate = F.try_divide(F.lit(1.0), median("_d"))
    if given:
        rate = F.coalesce(F.min_by(given, F.when(F.col(given).isNotNull(), F.col(time))), rate)
    return step.groupBy(*keys).agg(rate.alias("fs_hz"))


def summary(series: DataFrame, keys: Sequence[str], time: str = "time_s", rate: str = "fs_hz") -> DataFrame:
    """keys, dur_s, fs_hz, n_rows"""
    return series.groupBy(*keys).agg(F.max(time).alias("dur_s"), F.min_by(rate, time).alias("fs_hz"), F.count("*").alias("n_rows"))


def preview(series: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = 10) -> DataFrame:
    """The first rows of each series."""
    return series.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= rows).drop("_n")


def first_wins(files: DataFrame) -> DataFrame:
    """One file of each subject and signal (rr and ppi are one), the first by path. files: subject_id, signal, path, …"""
    family = F.when(F.col("signal").isin("rr", "ppi"), "rr").otherwise(F.col("signal"))
    order = Window.partitionBy("subject_id", family).orderBy("path")
    return files.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def by_priority(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Each series from the first source that has any row of it; all sources have the same columns."""
    tagged = [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    both = tagged[0]
    for one in tagged[1:]:
        both = both.unionByName(one)
    best = F.min("_p").over(Window.partitionBy(*keys))
    return both.withColumn("_best", best).where("_p = _best").drop("_p", "_best")


def grouped(subjects: DataFrame, start: int, end: int, values: dict[str, int], name: str = "task", subject: str = "subject_id") -> DataFrame:
    """subjects with a group from characters of the id; those with other characters are left out."""
    code = F.substring(subject, start + 1, end - start)
    mapped = F.coalesce(*(F.when(code == k, F.lit(v)) for k, v in values.items()))
    return subjects.withColumn(name, mapped).where(F.col(name).isNotNull())


def zero_based(table: DataFrame, column: str) -> DataFrame:
    """A column of numbers whose least is one, lowered by one."""
    low = table.agg(F.min(F.col(column).cast("double")).alias("_low"))  # one row
    return table.crossJoin(F.broadcast(low)).withColumn(column, F.when(F.col("_low") == 1, F.col(column) - 1).otherwise(F.col(column))).drop("_low")


def binary_codes(table: DataFrame, column: str, name: str = "task01") -> DataFrame:
    """table with 0 and 1 for the first two levels in order; 0/1 stay, further levels are null."""
    levels = table.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    first = levels.orderBy("_v").limit(2).agg(F.sort_array(F.collect_list("_v")).alias("_l"))
    code = F.when(F.col(column) == F.get("_l", F.lit(0)), 0).when(F.col(column) == F.get("_l", F.lit(1)), 1)
    if isinstance(table.schema[column].dataType, T.NumericType):  # a lone 1 of a 0/1 coding stays 1
        code = F.when((F.size("_l") == 1) & F.col(column).isin(0, 1), F.col(column).cast("int")).otherwise(code)
    return table.crossJoin(F.broadcast(first)).withColumn(name, code).drop("_l")
