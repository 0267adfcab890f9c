"""Beats from an ECG: zero-phase band-pass, R peaks, intervals between them; and recordings laid on an even grid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somaframe.functions import kernels as K
from somaframe.functions.frames import spread
from somaframe.functions.pieces import Pieces, done, same
from somaframe.functions.selection import percentiles

BAND, ORDER = (5.0, 20.0), 3
LEAST_SECONDS, PROMINENCE = 0.30, 0.20
#: A chunk of a recording, and what it sees of its neighbours (the filter settles within one second).
CHUNK_SECONDS, PAD_SECONDS = 600.0, 10.0
RANGE_ACCURACY = 100_000


def chunked(ecg: DataFrame, chunk: float = CHUNK_SECONDS, pad: float = PAD_SECONDS, within: tuple[str, str] | None = None) -> DataFrame:
    """The samples with _c, their chunk of the recording; those within pad of a border are in the neighbour as well.
    within: columns with the recording's first and last chunk, beyond which there is no neighbour."""
    if not 0 < pad < chunk:
        raise ValueError("0 < pad < chunk is asked for")
    part = lambda shift: F.floor((F.col("time_s") + shift) / chunk)
    parts = F.array_distinct(F.array(part(-pad), part(pad)))
    if within:
        parts = F.filter(parts, lambda c: c.between(F.col(within[0]), F.col(within[1])))
    return ecg.dropna(subset=["time_s", "value"]).withColumn("_c", F.explode(parts))


def _chunk(chunk: float) -> Column:
    return F.floor(F.col("time_s") / chunk)


def _steps(ecg: DataFrame, keys: Sequence[str], chunk: float, pad: float) -> DataFrame:
    """The samples with their chunk and _d, the time since the sample before; null where there is none in the chunk or pad seconds before it."""
    order = Window.partitionBy(*keys, "_c").orderBy("time_s")
    ahead = F.array_distinct(F.array(_chunk(chunk), F.floor((F.col("time_s") + pad) / chunk)))
    rows = ecg.dropna(subset=["time_s", "value"]).withColumn("_c", F.explode(ahead))
    return rows.withColumn("_d", F.col("time_s") - F.lag("time_s").over(order)).where(_chunk(chunk) == F.col("_c"))


def peaks(ecg: DataFrame, keys: Sequence[str] = ("subject_id",), chunk: float = CHUNK_SECONDS, pad: float = PAD_SECONDS) -> DataFrame:
    """keys, t_s of the R peaks. One group is one chunk of a subject's recording with its borders, so that a long recording
    is dealt to many tasks; the sampling rate and the range of the filtered signal are the whole recording's."""
    kinds = {f.name: f.dataType.simpleString() for f in ecg.schema.fields}
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    # rounded, so that few different steps are counted
    rows = ecg.select(*keys, "time_s", "value")
    ends = (F.min(_chunk(chunk)).alias("_first"), F.max(_chunk(chunk)).alias("_last"))
    typical = F.percentile(F.when(F.col("_d") > 0, F.round("_d", 9)), F.lit(0.5))
    steps = _steps(rows, keys, chunk, pad).groupBy(*keys).agg(typical.alias("_step"), *ends).where("_step IS NOT NULL")

    def own(t: np.ndarray, c: int) -> np.ndarray:
        return np.floor(t / chunk) == c

    def head(rows: pa.Table, n: int) -> dict:
        return {k: pa.repeat(rows[k][0], n) for k in keys}

    def column(rows: pa.Table, name: str) -> np.ndarray:
        return rows[name].to_numpy().astype(float)

    # arrays, not tables: a table's own work on a short recording costs more than the filter does
    def filtered(rows: pa.Table) -> pa.Table:
        t, v, rate = column(rows, "time_s"), column(rows, "value"), 1 / rows["_step"][0].as_py()
        order = np.lexsort((v, t))
        t, v = t[order], v[order]
        single = np.append(True, t[1:] != t[:-1])
        t, v = t[single], v[single]
        high = min(BAND[1], 0.45 * rate)
        try:
            v = K.zero_phase(*K.band_pass(ORDER, min(BAND[0], high / 2), high, rate), v)
        except ValueError:
            pass  # under 22 samples: the raw signal
        core = own(t, rows["_c"][0].as_py())
        return pa.table({**head(rows, core.sum()), "time_s": t[core], "value": v[core], "_step": np.full(core.sum(), 1 / rate)})

    def found(rows: pa.Table) -> pa.Table:
        t, v, first = column(rows, "time_s"), column(rows, "value"), {c: rows[c][0].as_py() for c in ("_c", "_n", "_range", "_step")}
        order = np.argsort(t, kind="stable")
        t, v, at = t[order], v[order], np.zeros(0)
        if first["_n"] >= 5:
            lo, hi = first["_range"]
            at = t[K.peaks(v, max(1, round(LEAST_SECONDS / first["_step"])), max(1e-3, PROMINENCE * (hi - lo)))]
            at = at[own(at, first["_c"])]
        return pa.table({**head(rows, len(at)), "t_s": at})

    within = ("_first", "_last")
    smooth = spread(chunked(rows.join(steps, list(keys)), chunk, pad, within).drop(*within), *keys, "_c").groupBy(*keys, "_c").applyInArrow(filtered, f"{named}, time_s double, value double, _step double")
    range_ = smooth.groupBy(*keys).agg(F.percentile_approx("value", [0.01, 0.99], RANGE_ACCURACY).alias("_range"), F.count("*").alias("_n"), *ends)
    again = spread(chunked(smooth.join(range_, list(keys)), chunk, pad, within).drop(*within), *keys, "_c")
    return again.groupBy(*keys, "_c").applyInArrow(found, f"{named}, t_s double")


def to_beats(ecg: DataFrame, keys: Sequence[str] = ("subject_id",), gap_factor: float | None = 5.0, chunk: float = CHUNK_SECONDS, pad: float = PAD_SECONDS) -> DataFrame:
    """keys, seq, t_s, rr_ms at the later peak. Intervals over a break in the recording (a step of gap_factor median
    steps, a tenth of a second at least; any of pad seconds) are left out."""
    order = Window.partitionBy(*keys).orderBy("t_s")
    beats = peaks(ecg, keys, chunk, pad).withColumns({"_before": F.lag("t_s").over(order), "seq": F.row_number().over(order).cast("bigint")})
    beats = beats.where("_before IS NOT NULL").withColumn("rr_ms", (F.col("t_s") - F.col("_before")) * 1000)
    if gap_factor:
        steps = _steps(ecg.select(*keys, "time_s", "value"), keys, chunk, pad)
        typical = steps.groupBy(*keys).agg(F.percentile(F.round("_d", 9), F.lit(0.5)).alias("_dt"))
        breaks = steps.join(typical, list(keys)).where(F.col("_d").isNull() | (F.col("_d") > F.greatest(gap_factor * F.col("_dt"), F.lit(0.1))))
        breaks = breaks.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("time_s").alias("_at"))
        beats = beats.join(breaks, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_at") > F.col("_before"), F.col("_at") <= F.col("t_s")], "left_anti")
    return beats.select(*keys, "seq", "t_s", "rr_ms")


#: Bounds of the rate of an even grid; and how many of its points one row is blown up to at once.
LEAST_RATE, MOST_RATE = 50.0, 2000.0
GRID_BLOCK = 10_000


def resampled(ecg: DataFrame, keys: Sequence[str] = ("subject_id",), pieces: Pieces | None = None) -> DataFrame:
    """keys, n, time_s, value, fs_hz: recordings on an even grid from their first sample on, linear between samples; the rate is
    one over the median step, a whole number within bounds. Recordings of under five samples are left out.

    A sample and the one after it give the grid points between them, so nothing is ordered but for that one step; a long break
    is filled in blocks of points. Of samples at one time the lowest counts for what comes before, the highest for what follows."""
    rows = ecg.select(*keys, "time_s", "value").dropna().where(~F.isnan("time_s") & ~F.isnan("value"))
    follow = lambda df, order: df.withColumns({"_t1": F.lead("time_s").over(order), "_v1": F.lead("value").over(order)})
    if pieces is None:
        rows = follow(rows, Window.partitionBy(*keys).orderBy("time_s", "value"))
    else:
        rows = done(pieces.around(rows, 1, follow, keys, "time_s", ("value",)))
    steps = percentiles(rows.withColumn("_d", F.col("_t1") - F.col("time_s")).where("_d > 0"), "_d", (0.5,), ("_step",), keys)
    rate = F.greatest(F.lit(LEAST_RATE), F.least(F.lit(MOST_RATE), F.bround(1 / F.col("_step"), 0)))
    known = same(rows.groupBy(*keys).agg(F.min("time_s").alias("_t0"), F.count("*").alias("_n")).where("_n >= 5"), steps, keys).select(*keys, "_t0", rate.alias("fs_hz"))
    rows = same(rows.where("_t1 IS NOT NULL"), known, keys)
    place = lambda t: F.ceil((F.col(t) - F.col("_t0")) * F.col("fs_hz"))
    rows = rows.withColumns({"_a": place("time_s"), "_b": place("_t1") - 1}).where("_b >= _a")
    rows = rows.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_a") / GRID_BLOCK), F.floor(F.col("_b") / GRID_BLOCK))))
    first = F.col("_block") * GRID_BLOCK
    rows = rows.withColumn("n", F.explode(F.sequence(F.greatest("_a", first), F.least("_b", first + (GRID_BLOCK - 1)))))
    at = F.col("_t0") + F.col("n") / F.col("fs_hz")
    value = F.col("value") + (F.col("_v1") - F.col("value")) * (at - F.col("time_s")) / (F.col("_t1") - F.col("time_s"))
    return rows.select(*keys, "n", at.alias("time_s"), value.alias("value"), "fs_hz")


def quick_beats(ecg: DataFrame, keys: Sequence[str] = ("subject_id",), pieces: Pieces | None = None) -> DataFrame:
    """keys, seq, t_s, rr_ms from the recording on an even grid, breaks bridged: what a device's beats are held against. A
    recording of under three peaks has none."""
    beats = to_beats(resampled(ecg, keys, pieces), keys, gap_factor=None)
    return beats.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n >= 2").drop("_n")
