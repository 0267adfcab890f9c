"""Points in intervals by one ordered pass: a join on ranges that never forms a pair it does not keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somaframe.functions.pieces import Pieces


def inside(intervals: DataFrame, points: DataFrame, time: str, keys: Sequence[str], seconds: float | None = None, start: str = "t0", end: str = "t1") -> DataFrame:
    """The points at start <= time < end of an interval with equal keys, with that interval's other columns.

    Intervals and points of a key are put in one order; each point takes the interval begun last, and stays if that has not
    ended. Intervals of one key must not overlap: where they do (a clock that was set back), a point counts for the
    one begun last. With `seconds`, time is cut into cells of that width, each a task's work, and the interval that is open
    at the end of a cell is carried into the next ones, so that a key with most of the rows is spread."""
    named = lambda df, but: [c for c in df.columns if c not in (*keys, *but)]
    own, theirs = named(intervals, (start,)), named(points, (time,))
    there = lambda df: df.dropna(subset=list(keys))
    begun = there(intervals).where(F.col(start).isNotNull()).select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(start), *own).alias("_interval"))
    seen = there(points).where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_kind"), F.struct(*([F.lit(0).alias("_")] if not theirs else theirs)).alias("_point"))
    rows = begun.unionByName(seen, allowMissingColumns=True)
    cells = [] if seconds is None else ["_piece"]
    if seconds is not None:
        rows = rows.withColumn("_piece", F.floor(F.col("_at") / seconds))
    order = Window.partitionBy(*keys, *cells).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_last", F.last("_interval", True).over(order))
    if seconds is not None:
        last = F.max_by("_interval", F.when(F.col("_interval").isNotNull(), F.col("_at")))
        found = Pieces.carried(found, {"_open": last}, {"_before": lambda w: F.last("_open", True).over(w.rowsBetween(Window.unboundedPreceding, -1))}, keys)
        found = found.withColumn("_last", F.coalesce("_last", "_before"))
    kept = found.where((F.col("_kind") == 1) & (F.col("_at") < F.col(f"_last.{end}")))
    return kept.select(*keys, F.col("_at").alias(time), *(F.col(f"_point.{c}").alias(c) for c in theirs), F.col(f"_last.{start}").alias(start), *(F.col(f"_last.{c}").alias(c) for c in own))
