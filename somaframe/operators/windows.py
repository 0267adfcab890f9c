"""Windows: cutting, guarding, numbering, nesting, and joining signals to them.

A window is a half-open interval [t_start_s, t_end_s) of a subject. Generators return subject_id, t_start_s,
t_end_s, meaning and def_order, one row per window; they read only marker or bounds tables, never signals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somaframe.config import LABELLED_WINDOWS, WindowDef
from somaframe.functions.frames import SUBJECT

COLUMNS = [SUBJECT, "t_start_s", "t_end_s", "meaning", "def_order"]
EPSILON = 1e-9
#: Sizes up to which a side is known to be small: window definitions are given by the caller.
MOST_DEFINITIONS = 10_000


def bounds(beats: DataFrame, time: str = "t_s") -> DataFrame:
    """First and last time of each subject: subject_id, t0, t1."""
    return beats.groupBy(SUBJECT).agg(F.min(time).alias("t0"), F.max(time).alias("t1"))


def _step(length: float, gap: float) -> float:
    if length <= 0 or length + gap <= 0:
        raise ValueError("windows need a positive length and step")
    return length + gap


def _slide(spans: DataFrame, length: float, gap: float, meaning: Column) -> DataFrame:
    """Windows of a length along (t0, t1): `gap` after each one, negative gaps overlap."""
    step = _step(length, gap)
    most = F.floor((F.col("t1") - F.col("t0") - length + EPSILON) / step)
    start = F.col("t0") + F.col("_i") * F.lit(float(step))
    laid = spans.where(most >= 0).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), most.cast("bigint"))))
    laid = laid.withColumns({"t_start_s": start, "t_end_s": start + float(length)})
    return laid.withColumns({"meaning": meaning, "def_order": F.col("_i").cast("int")}).select(*COLUMNS)


def consecutive(markers: DataFrame) -> DataFrame:
    """From each marker to the next."""
    order = Window.partitionBy(SUBJECT).orderBy("time_s", "seq")
    rows = markers.select(SUBJECT, F.col("time_s").alias("t_start_s"), F.lead("time_s").over(order).alias("t_end_s"), F.concat("label", F.lit("->"), F.lead("label").over(order)).alias("meaning"), F.row_number().over(order).cast("int").alias("def_order"))
    return rows.where(F.col("t_end_s").isNotNull())


def single(spans: DataFrame, start: float = 0.0, end: float | None = None, length: float | None = None) -> DataFrame:
    """One window per subject, relative to its first time and cut at its last; either end or length."""
    if (end is None) == (length is None):
        raise ValueError("give either an end or a length")
    stop = F.least(F.col("t0") + F.lit(float(end if end is not None else start + length)), F.col("t1"))
    return spans.select(SUBJECT, (F.col("t0") + F.lit(float(start))).alias("t_start_s"), stop.alias("t_end_s"), F.lit("single").alias("meaning"), F.lit(0).alias("def_order"))


def sliding(spans: DataFrame, length: float, gap: float = 0.0) -> DataFrame:
    return _slide(spans, length, gap, F.lit("sliding"))


def single_sliding(spans: DataFrame, start: float, end: float, length: float, gap: float = 0.0) -> DataFrame:
    """Sliding windows inside a range relative to the first time, cut at the last."""
    inner = spans.select(SUBJECT, (F.col("t0") + F.lit(float(start))).alias("t0"), F.least(F.col("t1"), F.col("t0") + F.lit(float(end))).alias("t1"))
    return _slide(inner, length, gap, F.lit("range"))


def inset_gaps(markers: DataFrame, insets: dict[int, float]) -> DataFrame:
    """The first gaps between markers, each moved in by its inset at both ends; keys are 1 to K. A subject
    needs more than K gaps."""
    if sorted(insets) != list(range(1, len(insets) + 1)):
        raise ValueError("insets are numbered from 1")
    gaps = consecutive(markers).withColumn("_n", F.count("*").over(Window.partitionBy(SUBJECT)))
    inset = F.element_at(F.array(*(F.lit(float(insets[k])) for k in sorted(insets))), F.col("def_order"))
    gaps = gaps.where((F.col("_n") > len(insets)) & (F.col("def_order") <= len(insets)))
    return gaps.select(SUBJECT, (F.col("t_start_s") + inset).alias("t_start_s"), (F.col("t_end_s") - inset).alias("t_end_s"), "meaning", "def_order")


def _definitions(markers: DataFrame, definitions: Sequence[WindowDef]) -> DataFrame:
    if len(definitions) > MOST_DEFINITIONS:
        raise ValueError("too many window definitions")
    rows = [(d.name, d.start, d.end, float(d.inset), k) for k, d in enumerate(definitions)]
    return markers.sparkSession.createDataFrame(rows, "meaning string, start_label string, end_label string, inset double, def_order int")


def labelled(markers: DataFrame, definitions: Sequence[WindowDef] = LABELLED_WINDOWS) -> DataFrame:
    """For each definition: from the first marker of its start label to the first of its end label, less the inset."""
    first = markers.groupBy(SUBJECT, F.trim("label").alias("label")).agg(F.min("time_s").alias("at"))
    ends = first.select(F.col(SUBJECT).alias("_s"), F.col("label").alias("end_label"), F.col("at").alias("_end"))
    named = first.withColumnRenamed("label", "start_label").join(F.broadcast(_definitions(markers, definitions)), "start_label")
    found = named.join(ends, (F.col(SUBJECT) == F.col("_s")) & (named["end_label"] == ends["end_label"]))
    return found.select(SUBJECT, (F.col("at") + F.col("inset")).alias("t_start_s"), (F.col("_end") - F.col("inset")).alias("t_end_s"), "meaning", "def_order")


def missing_labels(markers: DataFrame, definitions: Sequence[WindowDef] = LABELLED_WINDOWS) -> DataFrame:
    """subject_id, label: what labelled() would need and the subject lacks."""
    needed = sorted({x for d in definitions for x in (d.start, d.end)})
    have = markers.select(SUBJECT, F.trim("label").alias("label")).distinct()
    asked = markers.select(SUBJECT).distinct().withColumn("label", F.explode(F.array(*map(F.lit, needed))))
    return asked.join(have, [SUBJECT, "label"], "left_anti")


def around(markers: DataFrame, label: str, offset: float, length: float) -> DataFrame:
    """One window at an offset from the first marker of a label; no marker, no window."""
    at = markers.where(F.trim("label") == label).groupBy(SUBJECT).agg(F.min("time_s").alias("at"))
    start = F.col("at") + F.lit(float(offset))
    return at.select(SUBJECT, start.alias("t_start_s"), (start + F.lit(float(length))).alias("t_end_s"), F.lit(label).alias("meaning"), F.lit(0).alias("def_order"))


def between_sliding(markers: DataFrame, spans: DataFrame, start: str, end: str, length: float, gap: float = 0.0) -> DataFrame:
    """Sliding windows between the last markers of two labels, inside the recording."""
    at = markers.groupBy(SUBJECT).agg(F.max(F.when(F.trim("label") == start, F.col("time_s"))).alias("a"), F.max(F.when(F.trim("label") == end, F.col("time_s"))).alias("b"))
    inner = spans.join(at.where("a IS NOT NULL AND b IS NOT NULL"), SUBJECT).select(SUBJECT, F.greatest("t0", "a").alias("t0"), F.least("t1", "b").alias("t1"))
    return _slide(inner, length, gap, F.lit(f"{start}->{end}"))


def guarded(windows: DataFrame, least: float = 1.0) -> DataFrame:
    """Windows that end after they begin and last `least` seconds or more."""
    return windows.where((F.col("t_end_s") > F.col("t_start_s")) & (F.col("t_end_s") - F.col("t_start_s") >= least))


def numbered(windows: DataFrame, level: int = 1) -> DataFrame:
    """level, w_id by start, no parent, and the path of ids."""
    order = Window.partitionBy(SUBJECT).orderBy("t_start_s", "t_end_s", "def_order", "meaning")
    w_id = F.row_number().over(order).cast("int")
    return windows.select(
        SUBJECT, F.lit(level).alias("level"), w_id.alias("w_id"), F.lit(None).cast("int").alias("parent_level"), F.lit(None).cast("int").alias("parent_w_id"),
        "t_start_s", "t_end_s", "meaning", F.format_string("L%d_w%02d", F.lit(level), w_id).alias("lineage_path"),
    )


def subdivided(windows: DataFrame, parent_w_id: int, level: int, length: float, gap: float = 0.0) -> DataFrame:
    """Windows of the next level inside every subject's window parent_w_id of `level`."""
    parent = windows.where((F.col("level") == level) & (F.col("w_id") == parent_w_id))
    spans = parent.select(SUBJECT, F.col("t_start_s").alias("t0"), F.col("t_end_s").alias("t1"))
    child = numbered(guarded(_slide(spans, length, gap, F.lit("sliding"))), level + 1)
    known = parent.select(F.col(SUBJECT).alias("_s"), F.col("meaning").alias("_meaning"), F.col("lineage_path").alias("_path"))
    return child.join(known, F.col(SUBJECT) == F.col("_s")).select(
        SUBJECT, "level", "w_id", F.lit(level).alias("parent_level"), F.lit(parent_w_id).alias("parent_w_id"), "t_start_s", "t_end_s",
        F.concat("_meaning", F.lit("/"), "meaning").alias("meaning"), F.concat("_path", F.lit("/"), "lineage_path").alias("lineage_path"),
    )


def faults(windows: DataFrame) -> DataFrame:
    """What makes a collection of levels invalid: ids that repeat, windows that end before they begin."""
    twice = windows.groupBy(SUBJECT, "level", "w_id").agg(F.count("*").alias("n")).where("n > 1").select(SUBJECT, "level", "w_id", F.lit("repeated").alias("fault"))
    return twice.unionByName(windows.where("t_end_s < t_start_s").select(SUBJECT, "level", "w_id", F.lit("reversed").alias("fault")))


def collected(levels: Sequence[DataFrame]) -> DataFrame:
    """All levels, columns that some lack null there."""
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one, allowMissingColumns=True)
    return out


def leaves(windows: DataFrame) -> DataFrame:
    """Windows that are nobody's parent, with their duration and order."""
    parents = windows.where("parent_w_id IS NOT NULL").select(F.col(SUBJECT).alias("_s"), F.col("parent_level").alias("_l"), F.col("parent_w_id").alias("_w")).distinct()
    left = windows.join(parents, (F.col(SUBJECT) == F.col("_s")) & (F.col("level") == F.col("_l")) & (F.col("w_id") == F.col("_w")), "left_anti")
    order = Window.partitionBy(SUBJECT).orderBy("t_start_s", "t_end_s", "level", "w_id")
    return left.withColumns({"duration_s": F.col("t_end_s") - F.col("t_start_s"), "final_order": F.row_number().over(order).cast("int")})


def renamed(leaf: DataFrame, names: Sequence[str]) -> DataFrame:
    """Meanings by order, if every subject has exactly as many leaves as there are names; else unchanged."""
    counts = leaf.groupBy(SUBJECT).agg(F.count("*").alias("n"))
    fits = counts.agg(F.coalesce(F.bool_and(F.col("n") == len(names)), F.lit(False)).alias("_fits"))  # one row
    name = F.element_at(F.array(*map(F.lit, names)), F.col("final_order"))
    return leaf.crossJoin(F.broadcast(fits)).withColumn("meaning", F.when(F.col("_fits"), name).otherwise(F.col("meaning"))).drop("_fits")


def on_axis(leaf: DataFrame) -> DataFrame:
    """w_s and w_e: seconds from the subject's first leaf, to hundredths, tiny values as zero."""
    t0 = F.min("t_start_s").over(Window.partitionBy(SUBJECT))
    start = F.bround(F.col("t_start_s") - t0, 2)
    start = F.when(F.abs(start) < 0.005, 0.0).otherwise(start)
    return leaf.withColumn("w_s", start).withColumn("w_e", F.bround(F.col("w_s") + F.bround(F.col("t_end_s") - F.col("t_start_s"), 2), 2))


def sliced(signal: DataFrame, windows: DataFrame, time: str = "t_s", bucket: float | None = None) -> DataFrame:
    """Rows of a signal with each window they lie in.

    The join is by subject, the range is checked on its rows. Where subjects have many windows, or one
    subject most of the rows, `bucket` (seconds) also deals both sides by time: a window is repeated for each
    bucket that it touches, and each row meets the windows of its own bucket only."""
    cut = windows.select(F.col(SUBJECT).alias("_s"), *(c for c in windows.columns if c != SUBJECT))
    inside = (F.col(time) >= F.col("t_start_s")) & (F.col(time) < F.col("t_end_s")) & (F.col(SUBJECT) == F.col("_s"))
    if bucket is None:
        return signal.join(cut, inside).drop("_s")
    first, last = F.floor(F.col("t_start_s") / bucket), F.floor(F.col("t_end_s") / bucket)
    dealt = cut.where("t_end_s > t_start_s").withColumn("_wb", F.explode(F.sequence(first, last)))
    return signal.withColumn("_rb", F.floor(F.col(time) / bucket)).join(dealt, inside & (F.col("_rb") == F.col("_wb"))).drop("_s", "_wb", "_rb")


def missing(signal: DataFrame, windows: DataFrame, time: str = "t_s") -> DataFrame:
    """Windows without a row of the signal."""
    rows = signal.select(F.col(SUBJECT).alias("_s"), F.col(time).alias("_t"))
    return windows.join(rows, (F.col(SUBJECT) == F.col("_s")) & (F.col("_t") >= F.col("t_start_s")) & (F.col("_t") < F.col("t_end_s")), "left_anti")


def segments(leaf: DataFrame, signals: Sequence[str]) -> DataFrame:
    """One row for each leaf and signal, with the names that a file of it would have."""
    each = leaf.withColumn("signal", F.explode(F.array(*map(F.lit, signals))))
    return each.select(SUBJECT, "signal", "final_order", F.col("level").alias("src_level"), F.col("w_id").alias("src_w_id"), F.format_string("%s_%s_w%02d", F.col(SUBJECT).cast("string"), "signal", "w_id").alias("src_name"), F.format_string("%s_%s_w%02d", F.col(SUBJECT).cast("string"), "signal", "final_order").alias("dst_name"))


def event_time(markers: DataFrame, wanted: str) -> DataFrame:
    """subject_id, time_s of the marker that matches a text best: equal (whatever the case) before containing it."""
    low, text = F.lower("label"), wanted.lower()
    rank = F.when(low == text, 0).when(low.contains(text), 1)
    return markers.where(rank.isNotNull()).groupBy(SUBJECT).agg(F.min_by("time_s", F.struct(rank, "time_s", "seq")).alias("time_s"))


def clamped(spans: DataFrame, start: Column, end: Column) -> DataFrame:
    """A span cut to the recording (t0, t1); null where nothing is left."""
    a, b = F.greatest(start, F.col("t0")), F.least(end, F.col("t1"))
    return spans.select(SUBJECT, F.when(a < b, a).alias("t_start_s"), F.when(a < b, b).alias("t_end_s"))


def next_level(windows: DataFrame) -> DataFrame:
    """One row: the level that windows cut next would have; levels are a column, not folders."""
    return windows.agg((F.coalesce(F.max("level"), F.lit(-1)) + 1).cast("int").alias("level"))
