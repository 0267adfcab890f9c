"""Cleaning beat series: finding short runs of bad beats, and splitting, dropping or refilling them.

Everything runs in the order of a subject's beats (t_s, then seq), so one shuffle by subject serves a chain of
steps. For recordings too long for one task, `pieces` cuts a subject's beats (functions/pieces.py); results are the same. Beats that a split adds have the seq of the beat they come from and `part` 1 to k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from somaframe.config import BeatRules
from somaframe.functions.folders import checkpoint
from somaframe.functions.frames import SUBJECT, centred, in_time, islands, median
from somaframe.functions.pieces import Pieces, done, first_after, last_before

RULES = BeatRules()


def rolling_median(value: str, rows: int = RULES.median_rows, order: WindowSpec | None = None) -> Column:
    """Centred, the row itself included; null unless max(3, rows // 2) values are there."""
    frame = centred(order or in_time(), rows)
    return F.when(F.count(value).over(frame) >= max(3, rows // 2), median(value).over(frame))


def _near(beats: DataFrame, reach: int, work: Callable[[DataFrame, WindowSpec], DataFrame], pieces: Pieces | None) -> DataFrame:
    """work() over a subject's beats in their order: all at once, or in pieces that see `reach` rows of their neighbours."""
    return work(beats, in_time()) if pieces is None else pieces.around(beats, reach, work)


def _candidates(beats: DataFrame, order: WindowSpec, rules: BeatRules) -> DataFrame:
    rr = F.col("rr_ms")
    marked = beats.withColumn("median", rolling_median("rr_ms", rules.median_rows, order))
    far = F.try_divide(F.abs(rr - F.col("median")), F.col("median")) > rules.relative
    jump = F.abs(rr - F.lag(rr).over(order)) > rules.jump
    none = F.lit(False)
    return marked.withColumn("candidate", F.coalesce(far, none) | F.coalesce((rr < rules.low) | (rr > rules.high), none) | F.coalesce(jump, none))


def medians(beats: DataFrame, rules: BeatRules = RULES, pieces: Pieces | None = None) -> DataFrame:
    """beats with `median`, their rolling_median()."""
    return done(_near(beats, _sides(rules), lambda rows, order: rows.withColumn("median", rolling_median("rr_ms", rules.median_rows, order)), pieces))


def candidates(beats: DataFrame, rules: BeatRules = RULES, pieces: Pieces | None = None) -> DataFrame:
    """beats with `median` and `candidate`: far from the local median, out of bounds, or a jump."""
    return done(_near(beats, _sides(rules), lambda rows, order: _candidates(rows, order, rules), pieces))


def _sides(rules: BeatRules) -> int:
    return max(1, rules.median_rows // 2)


def with_runs(beats: DataFrame, rules: BeatRules = RULES, pieces: Pieces | None = None) -> DataFrame:
    """candidates() with `run` (its number, for runs of at most longest_run beats) and `run_beats`.

    A piece sees longest_run + 1 beats of its neighbours with their marks: what it sees of a run that is longer is too long, too.
    Runs that begin in the pieces before are added to a run's number."""

    def marked(rows: DataFrame, order: WindowSpec) -> DataFrame:
        found = _candidates(rows, order, rules)
        found = found.withColumn("_begin", F.when(F.col("candidate") & ~F.coalesce(F.lag("candidate").over(order), F.lit(False)), 1).otherwise(0))
        found = found.withColumn("_island", F.when(F.col("candidate"), F.sum("_begin").over(order.rowsBetween(Window.unboundedPreceding, 0))))
        near = [SUBJECT] if pieces is None else [SUBJECT, "_at"]
        return found.withColumn("_n", F.when(F.col("candidate"), F.count("*").over(Window.partitionBy(*near, "_island"))))

    found = _near(beats, _sides(rules) + rules.longest_run + 1, marked, pieces)
    if pieces is not None:
        found = pieces.carried(found, {"_begun": F.sum("_begin")}, {"_earlier": lambda w: F.coalesce(F.sum("_begun").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        own = F.sum("_begin").over(pieces.order().rowsBetween(Window.unboundedPreceding, 0))
        found = found.withColumn("_island", F.when(F.col("candidate"), F.col("_earlier") + own)).drop("_earlier")
    short = F.col("_n") <= rules.longest_run
    return done(found.withColumns({"run": F.when(short, F.col("_island")), "run_beats": F.when(short, F.col("_n"))}).drop("_begin", "_island", "_n"))


def runs(beats: DataFrame, rules: BeatRules = RULES, pieces: Pieces | None = None) -> DataFrame:
    """One row for each short run: beats, times, and whether neighbours compensate each other (half of the pairs
    of adjacent beats sum to about twice the local median)."""
    pair = Window.partitionBy(SUBJECT, "run").orderBy("t_s", "seq")
    found = with_runs(beats, rules, pieces).where("run IS NOT NULL")
    twice = 2 * F.coalesce("median", "rr_ms")
    off = F.when(twice > 0, F.abs(F.col("rr_ms") + F.lead("rr_ms").over(pair) - twice) / twice < rules.pair_tolerance)
    found = found.withColumn("_ok", off)
    return found.groupBy(SUBJECT, "run").agg(
        F.count("*").alias("n_beats"), F.min("t_s").alias("t_start"), F.max("t_s").alias("t_end"),
        F.coalesce(F.avg(F.col("_ok").cast("double")) >= 0.5, F.lit(False)).alias("compensation"),
    )


def split_multiples(beats: DataFrame, rules: BeatRules = RULES, pieces: Pieces | None = None) -> DataFrame:
    """Long beats that are k local medians become k equal ones over the time since the beat before."""
    rr, m = F.col("rr_ms"), F.col("_m")
    k = F.bround(F.try_divide(rr, m)).cast("int")
    marked = _near(beats, _sides(rules), lambda rows, order: rows.withColumn("_m", rolling_median("rr_ms", rules.median_rows, order)).withColumns({"_k": k, "_dt": F.col("t_s") - F.lag("t_s").over(order)}), pieces)
    fits = (rr >= rules.multiple_least) & F.col("_k").between(2, rules.multiple_most) & (F.abs(rr - F.col("_k") * m) / (F.col("_k") * m) < rules.multiple_tolerance) & (F.col("_dt") > 0)
    marked = done(marked).withColumn("_k", F.when(F.coalesce(fits, F.lit(False)), F.col("_k")).otherwise(1))
    cut = marked.withColumn("part", F.explode(F.sequence(F.lit(1), "_k")))
    many = F.col("_k") > 1
    return cut.withColumns({
        "t_s": F.when(many, F.col("t_s") - F.col("_dt") + F.col("part") * F.col("_dt") / F.col("_k")).otherwise(F.col("t_s")),
        "rr_ms": F.when(many, F.col("_dt") * 1000 / F.col("_k")).otherwise(rr),
    }).drop("_m", "_k", "_dt")


def dropped(beats: DataFrame, rules: BeatRules = RULES, pieces: Pieces | None = None) -> DataFrame:
    """Beats outside short runs."""
    return with_runs(beats, rules, pieces).where("run IS NULL").drop("median", "candidate", "run", "run_beats")


def _between_good(rows: DataFrame, bad: Column, pieces: Pieces | None, **more: Column) -> DataFrame:
    """rows with _v0 and _t0, value and time of the last good beat before, _v1 and _t1, of the first good one after, and the same of `more`."""
    fields = {"_v": F.when(~bad, F.col("rr_ms")), "_t": F.when(~bad, F.col("t_s")), **more}
    order = in_time()
    if pieces is not None:
        rows, order = pieces.ranked(rows), pieces.order()
    rows = last_before(rows, order, {f"{n}0": c for n, c in fields.items()}, pieces)
    return done(first_after(rows, order, {f"{n}1": c for n, c in fields.items()}, pieces))


def linear_fill(beats: DataFrame, bad: str = "bad", pieces: Pieces | None = None) -> DataFrame:
    """beats with the values of bad rows interpolated linearly in time between good neighbours; before the first and after the last, the nearest."""
    marked = F.coalesce(F.col(bad), F.lit(True))
    rows = _between_good(beats, marked, pieces)
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide(F.col("t_s") - F.col("_t0"), F.col("_t1") - F.col("_t0"))
    filled = F.when(marked, F.coalesce(line, "_v0", "_v1")).otherwise(F.col("rr_ms"))
    return rows.withColumn("rr_ms", filled).drop("_v0", "_t0", "_v1", "_t1")


def cubic_fill(beats: DataFrame, bad: str = "bad", pieces: Pieces | None = None) -> DataFrame:
    """beats with bad rows filled by the monotone cubic through the good ones (Fritsch and Carlson), in time.

    Slopes at good beats come from windows over good beats only; a bad row takes values and slopes of its
    good neighbours. The ends take the nearest value. With fewer than two good beats, linear_fill()."""

    def steps(rows: DataFrame, order: WindowSpec) -> DataFrame:
        h0, h1 = F.col("t_s") - F.lag("t_s").over(order), F.lead("t_s").over(order) - F.col("t_s")
        d0 = F.try_divide(F.col("rr_ms") - F.lag("rr_ms").over(order), h0)
        d1 = F.try_divide(F.lead("rr_ms").over(order) - F.col("rr_ms"), h1)
        rows = rows.withColumns({"_h0": h0, "_h1": h1, "_d0": d0, "_d1": d1})
        return rows.withColumns({"_dm": F.lag("_d0").over(order), "_hm": F.lag("_h0").over(order), "_dp": F.lead("_d1").over(order), "_hp": F.lead("_h1").over(order)})

    good = _near(beats.where(~F.coalesce(F.col(bad), F.lit(True))), 2, steps, pieces)

    def end(h: Column, d: Column, h2: Column, d2: Column) -> Column:
        """Three-point slope at an end, kept monotone."""
        s = ((2 * h + h2) * d - h * d2) / (h + h2)
        s = F.when(F.signum(s) != F.signum(d), 0.0).when((F.signum(d) != F.signum(d2)) & (F.abs(s) > 3 * F.abs(d)), 3 * d).otherwise(s)
        return F.when(d2.isNull(), d).otherwise(s)

    w0, w1 = 2 * F.col("_h1") + F.col("_h0"), F.col("_h1") + 2 * F.col("_h0")
    inner = F.when(F.col("_d0") * F.col("_d1") <= 0, 0.0).otherwise((w0 + w1) / (w0 / F.col("_d0") + w1 / F.col("_d1")))
    slope = F.when(F.col("_d0").isNull(), end(F.col("_h1"), F.col("_d1"), F.col("_hp"), F.col("_dp"))).when(F.col("_d1").isNull(), end(F.col("_h0"), F.col("_d0"), F.col("_hm"), F.col("_dm"))).otherwise(inner)
    sloped = good.select(SUBJECT, "t_s", "seq", slope.alias("_slope"))
    rows = beats.join(sloped, [SUBJECT, "t_s", "seq"], "left").withColumn("_bad", F.coalesce(F.col(bad), F.lit(True)))
    rows = _between_good(rows, F.col("_bad"), pieces, _m=F.col("_slope"))
    h = F.col("_t1") - F.col("_t0")
    s = F.try_divide(F.col("t_s") - F.col("_t0"), h)
    cubic = (2 * s**3 - 3 * s**2 + 1) * F.col("_v0") + (s**3 - 2 * s**2 + s) * h * F.col("_m0") + (-2 * s**3 + 3 * s**2) * F.col("_v1") + (s**3 - s**2) * h * F.col("_m1")
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * s
    filled = F.when(F.col("_bad"), F.coalesce(cubic, line, F.col("_v0"), F.col("_v1"))).otherwise(F.col("rr_ms"))
    return rows.withColumn("rr_ms", filled).drop("_slope", "_bad", "_v0", "_t0", "_v1", "_t1", "_m0", "_m1")


def weighted_fill(beats: DataFrame, rules: BeatRules = RULES, pieces: Pieces | None = None) -> DataFrame:
    """Single bad beats become the mean of their neighbours, weighted by nearness in time; longer runs are left."""

    def beside(rows: DataFrame, order: WindowSpec) -> DataFrame:
        return rows.withColumns({"_a": F.lag("rr_ms").over(order), "_c": F.lead("rr_ms").over(order), "_da": F.col("t_s") - F.lag("t_s").over(order), "_dc": F.lead("t_s").over(order) - F.col("t_s")})

    found = with_runs(done(_near(beats, 1, beside, pieces)), rules, pieces)
    mean = (F.col("_a") * F.col("_dc") + F.col("_c") * F.col("_da")) / (F.col("_da") + F.col("_dc"))
    fits = (F.col("run_beats") == 1) & (F.col("_da") > 0) & (F.col("_dc") > 0)
    found = found.withColumn("_v", F.when(fits, mean))
    return found.withColumns({"rr_ms": F.coalesce("_v", "rr_ms"), "bad": F.col("run").isNotNull() & F.col("_v").isNull()}).drop("_v", "_a", "_c", "_da", "_dc", "median", "candidate", "run", "run_beats")


def cleaned(beats: DataFrame, methods: tuple[str, ...] = ("split", "interp"), rules: BeatRules = RULES, fill: str = "pchip", pieces: Pieces | None = None) -> DataFrame:
    """The steps in order, split always first; each finds bad beats anew. In pieces, each reads its input several times, so
    marks and the results of steps are written to the checkpoint folder on the way."""
    kept = checkpoint if pieces is not None else lambda df: df
    out = kept(split_multiples(beats, rules, pieces).drop("part")) if "split" in methods else beats
    filler = cubic_fill if fill == "pchip" else linear_fill
    for method in methods:
        if method == "interp":
            marked = kept(with_runs(out, rules, pieces).withColumn("bad", F.col("run").isNotNull()))
            out = kept(filler(marked, pieces=pieces).select(*out.columns))
        elif method == "delete":
            out = kept(dropped(out, rules, pieces).select(*out.columns))
        elif method == "fill":
            out = kept(filler(kept(weighted_fill(out, rules, pieces)), pieces=pieces).select(*out.columns))
        elif method != "split":
            raise ValueError(f"unknown method {method}")
    return out


def quality(beats: DataFrame, both_bad: DataFrame | None = None, rules: BeatRules = RULES) -> DataFrame:
    """subject_id, n_segments, n_corrected, ratio_corrected, warning."""
    found = with_runs(beats, rules)
    counts = found.groupBy(SUBJECT).agg(F.count_distinct("run").alias("n_segments"), F.count("run").alias("n_corrected"), F.count("*").alias("_n"))
    counts = counts.withColumn("_ratio", F.col("n_corrected") / F.col("_n"))
    if both_bad is None:
        counts = counts.withColumn("both_bad", F.lit(False))
    else:
        counts = counts.join(both_bad.select(SUBJECT, "both_bad"), SUBJECT, "left")
    warnings = [
        F.when(F.col("n_segments") >= rules.many_runs, F.concat(F.lit("segments="), F.col("n_segments").cast("string"))),
        F.when(F.col("_ratio") >= rules.many_corrected, F.lit("many corrected")),
        F.when(F.col("both_bad"), F.lit("both sources bad")),
    ]
    return counts.select(SUBJECT, "n_segments", "n_corrected", F.bround("_ratio", 4).alias("ratio_corrected"), F.concat_ws("; ", *warnings).alias("warning"))


def both_bad(beats: DataFrame, reference: DataFrame, reach: float = 2.0, rules: BeatRules = RULES) -> DataFrame:
    """subject_id, both_bad: whether near some run the reference, too, is far from its local median."""
    near = runs(beats, rules).select(F.col(SUBJECT).alias("_s"), "run", "t_start", "t_end")
    inside = (F.col(SUBJECT) == F.col("_s")) & F.col("t_s").between(F.col("t_start") - reach, F.col("t_end") + reach)
    joined = reference.select(SUBJECT, "t_s", "rr_ms").join(near, inside)
    centre = joined.groupBy(SUBJECT, "run").agg(median("rr_ms").alias("_m"), F.count("*").alias("_n")).where("_n >= 3")
    off = joined.join(centre, [SUBJECT, "run"]).groupBy(SUBJECT, "run").agg(median(F.abs(F.col("rr_ms") - F.col("_m")) / F.col("_m")).alias("_d"))
    return off.groupBy(SUBJECT).agg(F.bool_or(F.col("_d") > rules.both_bad).alias("both_bad"))


def merged_intervals(intervals: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Whole-number intervals of a subject, those that overlap or touch made one."""
    order = Window.partitionBy(SUBJECT).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = intervals.withColumn("_new", F.when(reached.isNull() | (F.col(start) > reached + 1), 1).otherwise(0))
    grouped = begun.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(SUBJECT, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def ecg_marks(beats: DataFrame, rules: BeatRules = RULES, low_share: float = 0.9, pieces: Pieces | None = None) -> DataFrame:
    """beats with `bad` and `low` marks for series from an ECG: out of bounds, a relative jump, far from the median
    of five (edges repeated), and short beats below a share of it."""
    value = F.col("rr_ms")
    if pieces is None:
        whole = in_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        beats = beats.withColumns({"_first": F.first("rr_ms").over(whole), "_last": F.last("rr_ms").over(whole)})
    else:
        whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ends = {"_first": lambda w: F.first("_f").over(whole(w)), "_last": lambda w: F.last("_l").over(whole(w))}
        beats = done(pieces.carried(pieces.ranked(beats), {"_f": F.min_by("rr_ms", "_rank"), "_l": F.max_by("rr_ms", "_rank")}, ends))

    def five(rows: DataFrame, order: WindowSpec) -> DataFrame:
        near = F.array(*(F.coalesce(F.lag("rr_ms", k).over(order), "_first") for k in (2, 1)), value, *(F.coalesce(F.lead("rr_ms", k).over(order), "_last") for k in (1, 2)))
        return rows.withColumns({"median5": F.element_at(F.sort_array(near), 3), "_before": F.lag("rr_ms").over(order)})

    marked = done(_near(beats, 2, five, pieces))
    jump = F.abs(value - F.col("_before")) / F.col("_before") > rules.relative
    off = F.abs(value - F.col("median5")) / F.col("median5") > rules.relative
    none = F.lit(False)
    bad = (value < rules.low) | (value > rules.high) | F.coalesce(jump, none) | F.coalesce(off, none)
    return marked.withColumns({"bad": F.coalesce(bad, none), "low": F.coalesce(value < low_share * F.col("median5"), none)}).drop("_first", "_last", "_before")


def smoothed_near(beats: DataFrame, near: str = "near", pieces: Pieces | None = None) -> DataFrame:
    """The median of three on marked beats and their direct neighbours; a subject's ends stay."""

    def work(rows: DataFrame, order: WindowSpec) -> DataFrame:
        close = F.coalesce(F.col(near), F.lit(False)) | F.coalesce(F.lag(near).over(order), F.lit(False)) | F.coalesce(F.lead(near).over(order), F.lit(False))
        a, b, c = F.lag("rr_ms").over(order), F.col("rr_ms"), F.lead("rr_ms").over(order)
        mid = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
        return rows.withColumn("_v", F.when(close & a.isNotNull() & c.isNotNull(), mid).otherwise(b))

    return done(_near(beats, 1, work, pieces)).withColumn("rr_ms", F.col("_v")).drop("_v")


def cleaned_ecg(beats: DataFrame, rules: BeatRules = RULES) -> DataFrame:
    """Series from an ECG: short bad runs and all low runs; nothing if there are none, else all marks are refilled
    in time, smoothed near the runs, and marks that still jump by 20 % (Malik's rule) refilled again."""
    order = in_time()
    marked = islands(ecg_marks(beats, rules), F.col("bad"), order, "_run")
    n = F.count("*").over(Window.partitionBy(SUBJECT, "_run"))
    marked = marked.withColumn("near", (F.col("_run").isNotNull() & (n <= rules.longest_run)) | F.col("low"))
    marked = marked.withColumn("_any", F.bool_or("near").over(Window.partitionBy(SUBJECT)))
    marked = marked.withColumn("_mark", F.col("_any") & (F.col("bad") | F.col("low")))
    filled = smoothed_near(linear_fill(marked, "_mark").withColumn("near", F.col("near") & F.col("_any")), "near")
    again = filled.withColumn("_mark", F.col("_mark") & F.coalesce(F.abs(F.col("rr_ms") / F.lag("rr_ms").over(order) - 1) > rules.relative, F.lit(False)))
    return linear_fill(again, "_mark").select(*beats.columns)


def ectopic(value: Column, order: WindowSpec, share: float = RULES.relative) -> Column:
    """Whether a beat differs from the one before by more than a share of that one (Malik's rule), or one of them is
    missing; a subject's first beat is none."""
    before = F.lag(value).over(order)
    return F.coalesce(F.abs(before - value) > share * before, F.lit(True)) & (F.row_number().over(order) > 1)


def ectopic_refilled(beats: DataFrame, mark: str = "bad", rules: BeatRules = RULES) -> DataFrame:
    """beats with marked values filled anew: values out of bounds are taken out, then ectopic beats (the beat after an
    ectopic one counts as normal, so of a run every other one goes), and what is missing is put on a straight line
    between its neighbours by position; behind the last one, its value. Other values stay as they are."""
    order = in_time()
    rows = beats.withColumn("_x", F.when(F.col("rr_ms").between(rules.low, rules.high), F.col("rr_ms")))
    rows = islands(rows.withColumn("_e", ectopic(F.col("_x"), order, rules.relative)), F.col("_e"), order, "_run")
    own = Window.partitionBy(SUBJECT, "_run").orderBy("t_s", "seq")
    rows = rows.withColumn("_x", F.when(F.col("_run").isNull() | (F.row_number().over(own) % 2 == 0), F.col("_x")))
    place = F.row_number().over(order)
    rows = rows.withColumn("_p", place)
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    there = lambda c: F.when(F.col("_x").isNotNull(), F.col(c))
    v0, p0 = F.last(there("_x"), ignorenulls=True).over(back), F.last(there("_p"), ignorenulls=True).over(back)
    v1, p1 = F.first(there("_x"), ignorenulls=True).over(ahead), F.first(there("_p"), ignorenulls=True).over(ahead)
    rows = rows.withColumns({"_v0": v0, "_p0": p0, "_v1": v1, "_p1": p1})
    line = F.coalesce("_x", F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_p") - F.col("_p0")) / (F.col("_p1") - F.col("_p0")), "_v0")
    marked = F.coalesce(F.col(mark), F.lit(False)) | F.col("rr_ms").isNull()
    return rows.withColumn("rr_ms", F.when(marked, line).otherwise(F.col("rr_ms"))).select(*beats.columns)
