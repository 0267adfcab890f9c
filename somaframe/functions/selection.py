"""Exact percentiles of groups of any size, by two passes.

The first pass keeps a sketch of bounded size for each group, whose quantiles around a share bracket the wanted ranks for
certain. The second counts what lies below each bracket and ranks only what lies in it, about one row in ACCURACY / (2 * MARGIN),
equal values counted together before anything is ordered. No buffer holds a group's values; a group with most of the rows is
counted by all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somaframe.functions.pieces import same

#: One over the sketch's largest error in rank, and how many such errors a bracket reaches to either side.
ACCURACY, MARGIN = 10_000, 3


def percentiles(rows: DataFrame, value: str, shares: Sequence[float], names: Sequence[str], keys: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """keys and one column for each share: what percentile() gives, linear between ranks. Groups without values
    are left out; without keys there is one row, null if there is no value."""
    used = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    lo = [max(0.0, s - MARGIN / accuracy) for s in shares]
    hi = [min(1.0, s + MARGIN / accuracy) for s in shares]
    sketch = used.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", [*lo, *hi], accuracy).alias("_q"))
    at = range(len(shares))
    sketch = sketch.select(*keys, "_n", F.array(*(F.struct(F.lit(i).alias("i"), F.col("_q")[i].alias("lo"), F.col("_q")[i + len(shares)].alias("hi")) for i in at)).alias("_brackets"))
    known = same(used, sketch, keys) if keys else used.crossJoin(F.broadcast(sketch))  # one row
    inside = lambda b: (F.col("_v") >= b.lo) & (F.col("_v") <= b.hi)
    edges = known.groupBy(*keys).agg(
        *(F.count_if(F.col("_v") < F.col("_brackets")[i].lo).alias(f"_below{i}") for i in at),
        *(F.max(F.when(F.col("_v") < F.col("_brackets")[i].lo, F.col("_v"))).alias(f"_under{i}") for i in at),
        *(F.min(F.when(F.col("_v") > F.col("_brackets")[i].hi, F.col("_v"))).alias(f"_above{i}") for i in at),
    )
    near = known.select(*keys, "_v", F.explode(F.filter("_brackets", inside)).alias("_b")).groupBy(*keys, "_v", F.col("_b.i").alias("_i")).agg(F.count("*").alias("_k"))
    order = Window.partitionBy(*keys, "_i").orderBy("_v")
    ranked = near.withColumn("_upto", F.sum("_k").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = same(edges, sketch.select(*keys, "_n"), keys) if keys else edges.crossJoin(F.broadcast(sketch.select("_n")))
    # for each share: the value at the lower rank and at the next one. In groups so small that the margin is under a rank, a sketch's
    # own ranks may be one off, so the values next to a bracket on either side count as well
    wanted = sizes.select(*keys, F.explode(F.array(*(
        F.struct(F.lit(i).alias("_i"), F.col(f"_below{i}").alias("_below"), F.col(f"_under{i}").alias("_under"), F.col(f"_above{i}").alias("_above"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("_place")) for i, s in zip(at, shares, strict=True)
    ))).alias("_w")).select(*keys, "_w.*")
    found = same(ranked, wanted, [*keys, "_i"])
    low, high = F.floor("_place"), F.ceil("_place")
    at_rank = lambda rank: F.coalesce(F.min(F.when(F.col("_below") > rank, F.col("_under")).when(F.col("_below") + F.col("_upto") > rank, F.col("_v"))), F.first("_above"))
    picked = found.groupBy(*keys, "_i").agg(at_rank(low).alias("_a"), at_rank(high).alias("_b"), F.first("_place").alias("_place"))
    between = F.when(low == high, F.col("_a")).otherwise((high - F.col("_place")) * F.col("_a") + (F.col("_place") - low) * F.col("_b"))
    values = picked.select(*keys, "_i", between.alias("_p"))
    return values.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == i, F.col("_p"))).alias(n) for i, n in zip(at, names, strict=True)))
