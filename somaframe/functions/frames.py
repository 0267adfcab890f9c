"""Window frames and islands that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from somaframe.functions.shipping import ship

SUBJECT = "subject_id"


def in_time(*keys: str, time: str = "t_s") -> WindowSpec:
    """Rows of a subject in time; seq breaks ties."""
    return Window.partitionBy(*(keys or (SUBJECT,))).orderBy(time, "seq")


def centred(order: WindowSpec, rows: int) -> WindowSpec:
    """Centred frame: odd sizes have as many rows on either side, even ones one more before."""
    return order.rowsBetween(-(rows // 2), (rows - 1) // 2)


def islands(df: DataFrame, flag: Column, order: WindowSpec, name: str = "island") -> DataFrame:
    """A number for each run of rows on which flag is true, null elsewhere; numbers grow along the order."""
    counted = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    counted = counted.withColumn("_begin", F.when(F.col("_flag") & ~F.coalesce(F.lag("_flag").over(order), F.lit(False)), 1).otherwise(0))
    running = F.sum("_begin").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn(name, F.when(F.col("_flag"), running)).drop("_flag", "_begin")


def median(value: Column | str) -> Column:
    """Exact, from all values of a window at once; for groups that grow with a recording there is selection.percentiles()."""
    return F.percentile(value, F.lit(0.5))


#: Digits of a running total, and those behind the point: doubles of up to 10^10 to 10^-12.
TOTAL_DIGITS, TOTAL_SCALE = 22, 12


def exact_total(value: str, order: WindowSpec) -> Column:
    """The sum of decimals up to a row; null from the first value on that does not fit."""
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    digits = F.col(value).try_cast(f"decimal({TOTAL_DIGITS},{TOTAL_SCALE})")
    unfit = F.max(F.col(value).isNotNull() & digits.isNull()).over(so_far)
    return F.when(~unfit, F.sum(digits).over(so_far))


def running_total(value: str, order: WindowSpec) -> Column:
    """The sum up to a row, added as decimals and made a double at the end, so that a total that meets a border (a grid point, a breath's
    end) meets it exactly; a sum of doubles is off by its last bits, on one side or the other. Where a value does not fit, the sum of doubles."""
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(exact_total(value, order).cast("double"), F.sum(value).over(so_far))


def finite(value: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into the session's number of partitions. Work in grouped functions is not seen by adaptive
    execution, which would put small inputs into one task; a number that is asked for stays. Windows and groups by
    the same keys need no further shuffle. The package is sent to the executors, whose workers look such functions up."""
    ship(df.sparkSession)
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
