"""Per-window features in the frequency domain.

A window's beats become an evenly spaced tachogram (linear between beats), cut into half-overlapping
segments; each is freed of its line, tapered (periodic Hann) and transformed. Everything but the transform is
relational, grouped by (subject, window) or by segment.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somaframe.config import SpectrumRules
from somaframe.functions import kernels as K
from somaframe.functions.frames import exact_total, median
from somaframe.functions.shipping import ship
from somaframe.operators.time_domain import KEY

RULES = SpectrumRules()
TOP_HZ = 0.5


def tachogram(cut: DataFrame, rules: SpectrumRules = RULES, keys: Sequence[str] = KEY) -> DataFrame:
    """keys, n (from 0), x: beats on the grid; time is the running sum of intervals, from the first beat's end.

    Windows of under three beats, or of under least_points grid points, are left out. A beat's place on the grid comes from exact sums, so
    that a recording that ends on a grid point has no point behind its end; values between beats need no more digits than doubles have."""
    order = Window.partitionBy(*keys).orderBy("t_s", "seq")
    at = F.sum("rr_ms").over(order.rowsBetween(Window.unboundedPreceding, 0)) / 1000
    run = cut.withColumns({"_c": at, "_exact": exact_total("rr_ms", order)})
    whole = Window.partitionBy(*keys)
    run = run.withColumns({"_t": F.col("_c") - F.min("_c").over(whole), "_ms": (F.col("_exact") - F.min("_exact").over(whole)).cast("double"), "_beats": F.count("*").over(whole)})
    place = F.coalesce(F.col("_ms") * rules.rate / 1000, F.col("_t") * rules.rate)
    run = run.withColumn("_place", F.ceil(place).cast("bigint"))
    run = run.withColumns({"_next": F.lead("_t").over(order), "_value": F.lead("rr_ms").over(order), "_after": F.lead("_place").over(order), "_points": F.max("_place").over(whole)})
    run = run.where((F.col("_beats") >= 3) & (F.col("_points") >= rules.least_points) & (F.col("_next") > F.col("_t")))
    grid = run.where("_after > _place").withColumn("n", F.explode(F.sequence(F.col("_place"), F.col("_after") - 1)))
    x = F.col("rr_ms") + (F.col("_value") - F.col("rr_ms")) * (F.col("n") / rules.rate - F.col("_t")) / (F.col("_next") - F.col("_t"))
    return grid.select(*keys, "n", x.alias("x"))


def spectrum(grid: DataFrame, rate: float = RULES.rate, segment: int = RULES.segment, line: bool = True, keys: Sequence[str] = KEY, top: float = TOP_HZ) -> DataFrame:
    """keys, k, hz, power (density) of bins up to `top`: Welch's average over segments. line: remove a line, else the mean.

    A point goes to the one or two segments that hold it, whose values are gathered into an array of `segment` numbers at
    most; all arrays of a batch are transformed at once, and one row for each bin of a segment goes on."""
    ship(grid.sparkSession)
    whole = Window.partitionBy(*keys)
    sized = grid.withColumn("_all", F.count("*").over(whole)).withColumn("_size", F.least("_all", F.lit(segment)).cast("bigint"))
    hop = F.col("_size") - F.floor(F.col("_size") / 2)
    sized = sized.withColumns({"_hop": hop, "_segments": F.floor((F.col("_all") - F.floor(F.col("_size") / 2)) / hop)})
    # a point lies in at most two segments: the last that has begun, and the one before
    last = F.floor(F.col("n") / F.col("_hop"))
    member = sized.withColumn("_s", F.explode(F.array(last - 1, last))).withColumn("_i", F.col("n") - F.col("_s") * F.col("_hop"))
    member = member.where("_s >= 0 AND _s < _segments AND _i < _size")
    values = F.transform(F.sort_array(F.collect_list(F.struct("_i", "x"))), lambda p: p.x)
    arrays = member.groupBy(*keys, "_s").agg(values.alias("_x"))
    bins = F.floor(F.lit(top) * F.size("_x") / rate) + 1
    found = arrays.select(*keys, F.size("_x").alias("_size"), F.posexplode(F.slice(_densities("_x", F.lit(line)), F.lit(1), bins.cast("int"))).alias("k", "_p"))
    mean = found.groupBy(*keys, "k").agg((F.avg("_p") / rate).alias("power"), F.first(F.col("k") * rate / F.col("_size")).alias("hz"))
    return mean.select(*keys, F.col("k").cast("bigint").alias("k"), "hz", "power")


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _densities(x: pa.Array, line: pa.Array) -> pa.Array:
    """One-sided densities at a rate of one of each array, freed of its line or mean and tapered; arrays of a length are one matrix."""
    offsets, values = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)
    sizes, out = np.diff(offsets), [None] * len(x)
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == size)
        power = K.densities(values[offsets[own][:, None] + np.arange(size)], line[0].as_py())
        for i, row in zip(own.tolist(), power, strict=True):
            out[i] = row
    return pa.array(out, pa.list_(pa.float64()), from_pandas=True)


def area(low: Column | float, high: Column | float) -> Column:
    """Trapezoids between bins that both lie in [low, high]; needs _hz1 and _p1, the next bin."""
    inside = (F.col("hz") >= low) & (F.col("_hz1") <= high)
    return F.sum(F.when(inside, (F.col("power") + F.col("_p1")) / 2 * (F.col("_hz1") - F.col("hz"))))


def band_powers(density: DataFrame, breath: DataFrame | None = None, rules: SpectrumRules = RULES, keys: Sequence[str] = KEY) -> DataFrame:
    """keys, lf_ms2, hf_ms2, their logarithms, hf_center_hz and hf_band_used.

    breath: keys and f0. Inside the fixed band, f0 centres an individual one of twice the radius, moved to stay inside."""
    order = Window.partitionBy(*keys).orderBy("k")
    rows = density.withColumns({"_hz1": F.lead("hz").over(order), "_p1": F.lead("power").over(order)})
    low, high = rules.high
    if breath is None:
        rows = rows.withColumn("f0", F.lit(None).cast("double"))
    else:
        rows = rows.join(breath.select(*keys, "f0"), list(keys), "left")
    own = F.col("f0").between(low, high)
    a = F.least(F.greatest(F.col("f0") - rules.radius, F.lit(low)), F.lit(high - 2 * rules.radius))
    rows = rows.withColumns({"_own": F.coalesce(own, F.lit(False)), "_lo": F.when(own, a).otherwise(low), "_hi": F.when(own, a + 2 * rules.radius).otherwise(high)})
    sums = rows.groupBy(*keys).agg(
        area(*rules.low).alias("lf_ms2"), area(F.col("_lo") - 1e-9, F.col("_hi") + 1e-9).alias("hf_ms2"), F.first("_own").alias("_own"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")
    )
    log = lambda c: F.when(F.col(c) > 0, F.ln(c))
    return sums.select(
        *keys, "lf_ms2", log("lf_ms2").alias("lf_log_ms2"), "hf_ms2", log("hf_ms2").alias("hf_log_ms2"),
        F.when(F.col("_own"), (F.col("_lo") + F.col("_hi")) / 2).alias("hf_center_hz"), F.when(F.col("_own"), "individual").otherwise("fixed").alias("hf_band_used"),
    )


def breath_peak(resp: DataFrame, keys: Sequence[str] = KEY, segment: int = 512, rules: SpectrumRules = RULES, rate: float | None = None) -> DataFrame:
    """keys, f0: the frequency of the strongest bin of respiration between 0.1 and 0.5 Hz, over each window's longest
    stretch without holes. rate: samples per second; if not given, one over the median step of that stretch."""
    order = Window.partitionBy(*keys).orderBy("time_s", "seq")
    rows = resp.withColumn("_hole", F.when(F.col("value").isNull(), 1).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_hole").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("value IS NOT NULL")
    counts = rows.groupBy(*keys, "_run").agg(F.count("*").alias("_n"))
    best = counts.groupBy(*keys).agg(F.max_by("_run", F.struct("_n", -F.col("_run"))).alias("_run"))
    rows = rows.join(best, [*keys, "_run"])
    grid = rows.select(*keys, (F.row_number().over(order) - 1).cast("bigint").alias("n"), F.col("value").alias("x"))
    if rate is None:  # a spectrum in cycles per sample, each window's in its own unit after it
        steps = rows.withColumn("_d", F.col("time_s") - F.lag("time_s").over(order)).groupBy(*keys).agg(median("_d").alias("_step"))
        density = spectrum(grid, 1.0, segment, line=False, keys=keys).join(steps, list(keys)).withColumn("hz", F.col("hz") * F.coalesce(F.try_divide(F.lit(1.0), F.col("_step")), F.lit(1.0)))
    else:
        density = spectrum(grid, rate, segment, line=False, keys=keys, top=rules.breath[1])
    density = density.where(F.col("hz").between(*rules.breath))
    return density.groupBy(*keys).agg(F.max_by("hz", F.struct("power", -F.col("hz"))).alias("f0"))
