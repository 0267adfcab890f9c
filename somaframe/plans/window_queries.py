"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaframe.config import WindowDef
from somaframe.operators import windows as W
from somaframe.plans.registry import query
from somaframe.sources import sample_views as V

DAY = 86400.0
DEFS = (WindowDef("p_one", "view", "click", 60), WindowDef("g_one", "view", "click", 60), WindowDef("p_two", "signup", "error", 30), WindowDef("g_two", "click", "purchase", 10))
SQL_DEFS = "defs(meaning, s, e, inset, def_order) AS (VALUES ('p_one','view','click',60.0::DOUBLE,0), ('g_one','view','click',60.0,1), ('p_two','signup','error',30.0,2), ('g_two','click','purchase',10.0,3))"
SQL_BOUNDS = "spans AS (SELECT subject_id, min(t_s) AS t0, max(t_s) AS t1 FROM beats GROUP BY 1)"
SQL_SLIDE = """SELECT subject_id, t0 + i * {step}::DOUBLE AS t_start_s, t0 + i * {step}::DOUBLE + {length}::DOUBLE AS t_end_s, CAST(i AS INTEGER) AS def_order
    FROM (SELECT *, unnest(range(0, CAST(floor((t1 - t0 - {length}::DOUBLE + 1e-9) / {step}::DOUBLE) AS BIGINT) + 1)) AS i FROM {source})"""
OUT = "subject_id, round(t_start_s, 6) AS t_start_s, round(t_end_s, 6) AS t_end_s"
SQL_BEATS = f"WITH {V.SQL_BEATS}, {SQL_BOUNDS}"


def shown(windows: DataFrame, *more: str) -> DataFrame:
    return windows.select("subject_id", F.round("t_start_s", 6).alias("t_start_s"), F.round("t_end_s", 6).alias("t_end_s"), *more)


def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-day windows of each subject, numbered."""
    return W.numbered(W.guarded(W.sliding(W.bounds(V.beats(spark, sf_dir)), 5 * DAY)))


SQL_DAYS = f"""{V.SQL_BEATS}, {SQL_BOUNDS}, slid AS ({SQL_SLIDE.format(step=5 * DAY, length=5 * DAY, source="spans")}),
    wins AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY t_start_s) AS INTEGER) AS w_id FROM slid)"""


@query(f"WITH {V.SQL_MARKERS} SELECT * FROM (SELECT subject_id, round(time_s, 6) AS t_start_s, round(lead(time_s) OVER w, 6) AS t_end_s, label || '->' || lead(label) OVER w AS meaning FROM markers WINDOW w AS (PARTITION BY subject_id ORDER BY time_s, seq)) WHERE t_end_s IS NOT NULL")
def win_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.consecutive(V.markers(spark, sf_dir)), "meaning")


@query(f"{SQL_BEATS} SELECT subject_id, round(t0 + 20, 6) AS t_start_s, round(least(t0 + 20 + 86400 * 10, t1), 6) AS t_end_s FROM spans")
def win_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.single(W.bounds(V.beats(spark, sf_dir)), 20, length=10 * DAY))


@query(f"{SQL_BEATS} SELECT {OUT}, def_order FROM ({SQL_SLIDE.format(step=DAY, length=DAY, source='spans')})")
def win_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.sliding(W.bounds(V.beats(spark, sf_dir)), DAY), "def_order")


@query(f"{SQL_BEATS} SELECT {OUT}, def_order FROM ({SQL_SLIDE.format(step=DAY / 2, length=DAY, source='spans')})")
def win_sliding_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.sliding(W.bounds(V.beats(spark, sf_dir)), DAY, -DAY / 2), "def_order")


@query(f"""WITH {V.SQL_MARKERS}, gaps AS (SELECT subject_id, time_s AS a, lead(time_s) OVER w AS b, row_number() OVER w AS n FROM markers WINDOW w AS (PARTITION BY subject_id ORDER BY time_s, seq)),
    sized AS (SELECT *, count(*) OVER (PARTITION BY subject_id) AS many FROM gaps WHERE b IS NOT NULL)
    SELECT subject_id, round(a + CASE n WHEN 1 THEN 30 ELSE 60 END, 6) AS t_start_s, round(b - CASE n WHEN 1 THEN 30 ELSE 60 END, 6) AS t_end_s FROM sized WHERE many > 2 AND n <= 2""")
def win_events_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.inset_gaps(V.markers(spark, sf_dir), {1: 30, 2: 60}))


SQL_FIRST = "firsts AS (SELECT subject_id, trim(label) AS label, min(time_s) AS at FROM markers GROUP BY 1, 2)"
SQL_LABELLED = f"{V.SQL_MARKERS}, {SQL_DEFS}, {SQL_FIRST}, lab AS (SELECT a.subject_id, a.at + inset AS t_start_s, b.at - inset AS t_end_s, meaning, def_order FROM defs JOIN firsts a ON a.label = s JOIN firsts b ON b.label = e AND a.subject_id = b.subject_id)"


@query(f"WITH {SQL_LABELLED} SELECT {OUT}, meaning, def_order FROM lab WHERE t_end_s > t_start_s AND t_end_s - t_start_s >= 1")
def win_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.guarded(W.labelled(V.markers(spark, sf_dir), DEFS)), "meaning", "def_order")


@query(f"""WITH {V.SQL_MARKERS}, need(label) AS (VALUES ('view'), ('click'), ('refund')) SELECT u.subject_id, need.label FROM (SELECT DISTINCT subject_id FROM markers) u CROSS JOIN need
    WHERE NOT EXISTS (SELECT 1 FROM markers m WHERE m.subject_id = u.subject_id AND trim(m.label) = need.label)""")
def win_missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.missing_labels(V.markers(spark, sf_dir), [WindowDef("a", "view", "click", 0), WindowDef("b", "view", "refund", 0)])


@query(f"WITH {V.SQL_MARKERS} SELECT subject_id, round(min(time_s) - 30, 6) AS t_start_s, round(min(time_s) - 30 + 3600, 6) AS t_end_s FROM markers WHERE label = 'error' GROUP BY 1")
def win_events_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.around(V.markers(spark, sf_dir), "error", -30, 3600))


SQL_BETWEEN = f"WITH {V.SQL_BEATS}, {V.SQL_MARKERS}, {SQL_BOUNDS}, marks AS (SELECT subject_id, max(time_s) FILTER (WHERE label = 'view') AS a, max(time_s) FILTER (WHERE label = 'click') AS b FROM markers GROUP BY 1), inn AS (SELECT subject_id, greatest(t0, a) AS t0, least(t1, b) AS t1 FROM spans JOIN marks USING (subject_id) WHERE a IS NOT NULL AND b IS NOT NULL)"


@query(f"{SQL_BETWEEN} SELECT {OUT}, def_order FROM ({SQL_SLIDE.format(step=7200, length=3600, source='inn')})")
def win_events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = V.beats(spark, sf_dir)
    return shown(W.between_sliding(V.markers(spark, sf_dir), W.bounds(beats), "view", "click", 3600, 3600), "def_order")


@query(f"{SQL_BEATS}, inn AS (SELECT subject_id, t0 + 120 AS t0, least(t1, t0 + 999999) AS t1 FROM spans) SELECT {OUT}, def_order FROM ({SQL_SLIDE.format(step=DAY, length=DAY, source='inn')})")
def win_single_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.single_sliding(W.bounds(V.beats(spark, sf_dir)), 120, 999999, DAY), "def_order")


SQL_CHILD = f"kids AS ({SQL_SLIDE.format(step=DAY, length=DAY, source='(SELECT subject_id, t_start_s AS t0, t_end_s AS t1 FROM wins WHERE w_id = 2)')})"


@query(f"WITH {SQL_DAYS}, {SQL_CHILD} SELECT {OUT}, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY t_start_s) AS INTEGER) AS w_id, 'sliding/sliding' AS meaning, 'L1_w02/L2_w' || lpad(CAST(row_number() OVER (PARTITION BY subject_id ORDER BY t_start_s) AS VARCHAR), 2, '0') AS lineage_path FROM kids")
def win_subdivide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.subdivided(day_windows(spark, sf_dir), 2, 1, DAY), "w_id", "meaning", "lineage_path")


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = day_windows(spark, sf_dir)
    return W.collected([top, W.subdivided(top, 2, 1, DAY)])


SQL_NESTED = f"""{SQL_DAYS}, {SQL_CHILD}, leaf AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY t_start_s, t_end_s, level) AS INTEGER) AS final_order, t_end_s - t_start_s AS duration_s
    FROM (SELECT subject_id, 1 AS level, w_id, t_start_s, t_end_s FROM wins w WHERE NOT (w_id = 2 AND EXISTS (SELECT 1 FROM kids k WHERE k.subject_id = w.subject_id))
    UNION ALL SELECT subject_id, 2, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY t_start_s) AS INTEGER), t_start_s, t_end_s FROM kids))"""


@query(f"WITH {SQL_NESTED} SELECT {OUT}, level, w_id, final_order, round(duration_s, 3) AS duration_s FROM leaf")
def win_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(W.leaves(nested(spark, sf_dir)), "level", "w_id", "final_order", F.round("duration_s", 3).alias("duration_s"))


@query(f"WITH {SQL_DAYS} SELECT subject_id, w_id, 'L1_w' || lpad(CAST(w_id AS VARCHAR), 2, '0') AS lineage_path FROM wins")
def win_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_windows(spark, sf_dir).select("subject_id", "w_id", "lineage_path")


@query(f"""WITH {SQL_NESTED}, ax AS (SELECT *, min(t_start_s) OVER (PARTITION BY subject_id) AS t0 FROM leaf)
    SELECT subject_id, final_order, round_even(t_start_s - t0, 2) AS w_s, round_even(round_even(t_start_s - t0, 2) + round_even(t_end_s - t_start_s, 2), 2) AS w_e FROM ax""")
def win_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.on_axis(W.leaves(nested(spark, sf_dir))).select("subject_id", "final_order", "w_s", "w_e")


@query(f"""WITH {SQL_LABELLED}, good AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t_start_s, t_end_s, def_order, meaning) AS n FROM lab), fits AS (SELECT bool_and(c = 4) AS ok FROM (SELECT count(*) AS c FROM good GROUP BY subject_id))
    SELECT subject_id, CAST(n AS INTEGER) AS final_order, CASE WHEN ok THEN ['w1','w2','w3','w4'][n] ELSE meaning END AS meaning FROM good CROSS JOIN fits""")
def win_meaning_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = W.leaves(W.numbered(W.labelled(V.markers(spark, sf_dir), DEFS)))
    return W.renamed(leaf, ["w1", "w2", "w3", "w4"]).select("subject_id", "final_order", "meaning")


@query(f"WITH {SQL_DAYS} SELECT w.subject_id, w_id, count(*) AS n, round(min(b.t_s), 3) AS first_t FROM wins w JOIN beats b ON b.subject_id = w.subject_id AND b.t_s >= t_start_s AND b.t_s < t_end_s GROUP BY 1, 2")
def win_slice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = W.sliced(V.beats(spark, sf_dir), day_windows(spark, sf_dir), bucket=5 * DAY)
    return cut.groupBy("subject_id", "w_id").agg(F.count("*").alias("n"), F.round(F.min("t_s"), 3).alias("first_t"))


@query(f"WITH {V.SQL_BEATS}, {SQL_BOUNDS}, slid AS ({SQL_SLIDE.format(step=DAY / 4, length=DAY / 4, source='spans')}) SELECT {OUT} FROM slid w WHERE NOT EXISTS (SELECT 1 FROM beats b WHERE b.subject_id = w.subject_id AND b.t_s >= t_start_s AND b.t_s < t_end_s)")
def win_missing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = V.beats(spark, sf_dir)
    return shown(W.missing(beats, W.sliding(W.bounds(beats), DAY / 4)))


@query(f"WITH {SQL_NESTED} SELECT leaf.subject_id, signal, final_order, level AS src_level, w_id AS src_w_id, format('{{}}_{{}}_w{{:02d}}', leaf.subject_id, signal, w_id) AS src_name, format('{{}}_{{}}_w{{:02d}}', leaf.subject_id, signal, final_order) AS dst_name FROM leaf CROSS JOIN (VALUES ('rr'), ('resp')) s(signal)")
def win_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.segments(W.leaves(nested(spark, sf_dir)), ["rr", "resp"])


@query(f"WITH {SQL_NESTED} SELECT level, count(*) AS n FROM leaf GROUP BY 1")
def win_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.leaves(nested(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))


@query("SELECT 0 AS subject_id, 1 AS level, 1 AS w_id, '' AS fault WHERE false")
def win_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.faults(nested(spark, sf_dir))


@query(f"WITH {V.SQL_MARKERS} SELECT subject_id, round(min(time_s), 3) AS time_s FROM markers WHERE contains(label, 'sign') GROUP BY 1")
def event_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.event_time(V.markers(spark, sf_dir), "SIGN").select("subject_id", F.round("time_s", 3).alias("time_s"))
