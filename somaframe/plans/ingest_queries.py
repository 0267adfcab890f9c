"""Queries of the naming and normalising operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaframe.functions import names as N
from somaframe.operators import ingest as I
from somaframe.plans.registry import query
from somaframe.sources import sample_views as V

KINDS = ("rr_h10", "ECG", "Resp_belt", "ppg", "acc_verity", "markers", "notes", "heart_rate")
SQL_NAMES = "names AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN format('P{:03d}S001T{:03d}R001_', p_partkey % 900, p_partkey % 2 + 1) WHEN 1 THEN format('sub-P{:03d}_ses-S{:03d}_task-Default_run-001_', p_partkey % 500, p_partkey % 7) WHEN 2 THEN format('f{}o{:02d}_', p_partkey % 2 + 1, p_partkey % 50) WHEN 3 THEN format('rec{}_', p_partkey) ELSE 'plain_' END || ['rr_h10','ECG','Resp_belt','ppg','acc_verity','markers','notes','heart_rate'][CAST(p_partkey % 8 + 1 AS INTEGER)] AS name, p_size FROM part)"


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    front = (
        F.when(k % 5 == 0, F.format_string("P%03dS001T%03dR001_", k % 900, k % 2 + 1)).when(k % 5 == 1, F.format_string("sub-P%03d_ses-S%03d_task-Default_run-001_", k % 500, k % 7))
        .when(k % 5 == 2, F.format_string("f%do%02d_", k % 2 + 1, k % 50)).when(k % 5 == 3, F.format_string("rec%d_", k)).otherwise("plain_")
    )
    return V.table(spark, sf_dir, "part").select(k.alias("id"), F.concat(front, F.element_at(F.array(*map(F.lit, KINDS)), (k % 8 + 1).cast("int"))).alias("name"), "p_size")


@query(f"""WITH {SQL_NAMES} SELECT id, CASE WHEN contains(lower(name), 'ecg') THEN 'ecg' WHEN contains(lower(name), 'rr') OR contains(lower(name), 'ibi') OR contains(lower(name), 'ppi') THEN 'rr' WHEN contains(lower(name), 'hr') OR contains(lower(name), 'bpm') OR contains(lower(name), 'heart_rate') THEN 'hr'
    WHEN contains(lower(name), 'resp') OR contains(lower(name), 'breath') THEN 'resp' WHEN contains(lower(name), 'ppg') OR contains(lower(name), 'bvp') THEN 'ppg' WHEN contains(lower(name), 'acc') THEN 'acc' WHEN contains(lower(name), 'markers') OR contains(lower(name), 'events') THEN 'events' END AS signal FROM names""")
def detect_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_names(spark, sf_dir).select("id", N.detect_signal(F.col("name")).alias("signal"))


@query(rf"""WITH {SQL_NAMES}, x AS (SELECT id, lower(name) AS n FROM names), y AS (SELECT *, nullif(regexp_extract(n, 'sub-([a-z0-9]+)', 1), '') AS a, nullif(regexp_extract(n, 'ses-([a-z0-9]+)', 1), '') AS b, nullif(regexp_extract(n, 'task-([a-z0-9]+)', 1), '') AS c, nullif(regexp_extract(n, 'run-([a-z0-9]+)', 1), '') AS d FROM x)
    SELECT id, coalesce(upper(nullif(regexp_extract(n, '(p\d{{3}}s\d{{3}}t\d{{3}}r\d{{3}})', 1), '')), nullif(regexp_extract(n, '^(f[12][oy]\d{{2}})', 1), ''),
        CASE WHEN coalesce(a, b, c, d) IS NOT NULL THEN format('P{{:03d}}S{{:03d}}T{{:03d}}R{{:03d}}', coalesce(CAST(nullif(regexp_extract(a, '(\d+)', 1), '') AS INTEGER), 1), coalesce(CAST(nullif(regexp_extract(b, '(\d+)', 1), '') AS INTEGER), 1), coalesce(CAST(nullif(regexp_extract(c, '(\d+)', 1), '') AS INTEGER), 1), coalesce(CAST(nullif(regexp_extract(d, '(\d+)', 1), '') AS INTEGER), 1)) END,
        CASE WHEN regexp_extract(n, '(\d+)', 1) <> '' THEN format('P{{:03d}}S001T001R001', CAST(regexp_extract(n, '(\d+)', 1) AS INTEGER)) END) AS sid FROM y""")
def infer_sid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_names(spark, sf_dir).select("id", N.infer_subject(F.col("name")).alias("sid"))


SQL_SID = "sids AS (SELECT DISTINCT user_id, format('P{:03d}S001T{:03d}R001', user_id, user_id % 2 + 1) AS sid FROM events)"


def sids(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return V.table(spark, sf_dir, "events").select(u).distinct().withColumn("sid", F.format_string("P%03dS001T%03dR001", u, u % 2 + 1))


@query("""SELECT p_partkey AS id, coalesce(CAST(CAST(nullif(regexp_extract(v, 'P(\\d{3})', 1), '') AS INTEGER) AS VARCHAR), CAST(CAST(trunc(TRY_CAST(v AS DOUBLE)) AS BIGINT) AS VARCHAR), trim(v)) AS merge_id
    FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'xP007y' WHEN 1 THEN p_partkey || '.5' WHEN 2 THEN '  ' || p_name || ' ' ELSE CAST(p_partkey AS VARCHAR) END AS v FROM part)""")
def merge_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    v = F.when(k % 4 == 0, "xP007y").when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".5"))).when(k % 4 == 2, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise(k.cast("string"))
    return V.table(spark, sf_dir, "part").select(k.alias("id"), N.merge_id(v).alias("merge_id"))


@query("SELECT c_custkey AS id, CASE WHEN trim(v) NOT IN ('', 'NA', 'NaN', 'nan', 'None', 'null', 'NULL') THEN trim(v) END AS v FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' NA ' WHEN 1 THEN '' WHEN 2 THEN ' ' || c_mktsegment ELSE 'null' END AS v FROM customer)")
def blank_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    v = F.when(k % 4 == 0, " NA ").when(k % 4 == 1, "").when(k % 4 == 2, F.concat(F.lit(" "), "c_mktsegment")).otherwise("null")
    return V.table(spark, sf_dir, "customer").select(k.alias("id"), N.blank_to_null(v).alias("v"))


@query("SELECT p_partkey AS id, trim(split_part(p_name || ' (' || p_brand || ')', ' (', 1)) AS meaning, regexp_replace(p_brand, '[^0-9A-Za-z]+', '_', 'g') AS safe FROM part")
def clean_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.clean_meaning(text).alias("meaning"), N.safe_name(F.col("p_brand")).alias("safe"))


@query(f"WITH {SQL_SID} SELECT sid AS subject_id, CASE substring(sid, 10, 3) WHEN '001' THEN 1 WHEN '002' THEN 2 END AS task FROM sids WHERE substring(sid, 10, 3) IN ('001', '002')")
def group_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.grouped(sids(spark, sf_dir).select(F.col("sid").alias("subject_id")), 9, 12, {"001": 1, "002": 2})


@query(f"WITH {SQL_SID} SELECT sid AS subject_id, CAST(substring(sid, 10, 3) AS INTEGER) - 1 AS task FROM sids")
def zero_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.zero_based(I.grouped(sids(spark, sf_dir).select(F.col("sid").alias("subject_id")), 9, 12, {"001": 1, "002": 2}), "task")


@query("SELECT c_custkey AS id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 END::DOUBLE AS task01 FROM customer")
def binary_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.binary_codes(V.table(spark, sf_dir, "customer"), "c_mktsegment").select(F.col("c_custkey").alias("id"), F.col("task01").cast("double").alias("task01"))


@query(f"WITH {SQL_SID} SELECT sid, regexp_extract(sid, '^(P\\d+)', 1) AS short_subject, regexp_extract(sid, '(P\\d{{3}})', 1) AS short_label, CAST(nullif(regexp_extract(sid, '^[Pp]\\s*0*(\\d+)', 1), '') AS BIGINT) AS numeric_id FROM sids")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sid")
    return sids(spark, sf_dir).select("sid", N.short_subject(s).alias("short_subject"), N.short_label(s).alias("short_label"), N.numeric_id(s).alias("numeric_id"))


@query("SELECT o_orderkey AS id, CAST(trunc(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE)) AS BIGINT)::DOUBLE AS n FROM orders")
def coerce_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_totalprice").cast("string"))
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), N.coerce_int(v).cast("double").alias("n"))


@query(f"WITH {V.SQL_BEATS}, x AS (SELECT seq, CAST(round_even(t_s * 1000, 0) AS BIGINT) AS ms FROM beats) SELECT seq, format('{{:02d}}:{{:02d}}.{{:03d}}', ms // 60000, (ms // 1000) % 60, ms % 1000) AS minutes, format('{{}}:{{:02d}}:{{:02d}}.{{:03d}}', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS hours FROM x")
def clock_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.beats(spark, sf_dir).select("seq", N.minutes(F.col("t_s")).alias("minutes"), N.hours(F.col("t_s")).alias("hours"))



@query(f"""WITH {V.SQL_BEATS}, raw AS (SELECT subject_id, seq, CASE subject_id % 3 WHEN 0 THEN t_s * 1e6 WHEN 1 THEN floor(t_s) ELSE t_s / 100 END AS t FROM beats), d AS (SELECT *, abs(nullif(t - lag(t) OVER (PARTITION BY subject_id ORDER BY t), 0)) AS d FROM raw),
    k AS (SELECT subject_id, median(d) AS dt, max(t) AS mx, median(t) AS md, count(*) AS n FROM d GROUP BY 1)
    SELECT raw.subject_id, seq, round(t / CASE WHEN n < 3 OR dt IS NULL THEN 1 WHEN dt >= 1e5 THEN 1e6 WHEN dt >= 10 AND mx < 1e5 AND md < 1e5 THEN 1000 ELSE 1 END, 7) AS t FROM raw JOIN k ON k.subject_id = raw.subject_id""")
def seconds_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("subject_id") % 3
    raw = V.beats(spark, sf_dir).select("subject_id", "seq", F.when(s == 0, F.col("t_s") * 1e6).when(s == 1, F.floor("t_s").cast("double")).otherwise(F.col("t_s") / 100).alias("t"))
    return I.in_seconds(raw, ["subject_id"], "t").withColumn("t", F.round("t", 7))


@query(f"WITH {V.SQL_BEATS} SELECT seq, round(CASE WHEN v < 10 THEN v * 1000 ELSE v END, 6) AS rr_ms FROM (SELECT seq, CASE WHEN seq % 2 = 0 THEN rr_ms / 1000 ELSE rr_ms END AS v FROM beats)")
def rr_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("seq") % 2 == 0, F.col("rr_ms") / 1000).otherwise(F.col("rr_ms"))
    return V.beats(spark, sf_dir).select("seq", F.round(I.beat_unit(v), 6).alias("rr_ms"))


@query(f"WITH {V.SQL_BEATS}, g AS (SELECT subject_id, seq, floor(t_s / 50000) * 50000 AS t_s FROM beats) SELECT subject_id, t_s, min(seq) AS seq FROM g GROUP BY 1, 2")
def strict_monotone_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.beats(spark, sf_dir).select("subject_id", "seq", (F.floor(F.col("t_s") / 50000) * 50000.0).alias("t_s"))
    return I.strictly_increasing(rows, ["subject_id"]).select("subject_id", "t_s", "seq")


@query(f"WITH {V.SQL_BEATS}, q AS (SELECT subject_id, seq, CASE WHEN subject_id % 4 = 0 AND seq >= 100 THEN NULL WHEN subject_id % 4 = 1 AND seq % 5 = 0 THEN -t_s ELSE t_s END AS t FROM beats), d AS (SELECT *, t - lag(t) OVER (PARTITION BY subject_id ORDER BY seq) AS d FROM q) SELECT subject_id, CASE WHEN count(t) < 3 THEN 'too short' ELSE 'decreasing' END AS fault FROM d GROUP BY 1 HAVING count(t) < 3 OR count(*) FILTER (WHERE d < 0) > 0")
def invalid_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("subject_id") % 4
    rows = V.beats(spark, sf_dir).withColumn("t_s", F.when((s == 0) & (F.col("seq") >= 100), None).when((s == 1) & (F.col("seq") % 5 == 0), -F.col("t_s")).otherwise(F.col("t_s")))
    return I.invalid_series(rows, ["subject_id"])


@query(f"WITH {V.SQL_BEATS}, d AS (SELECT subject_id, nullif(t_s - lag(t_s) OVER (PARTITION BY subject_id ORDER BY t_s), 0) AS d FROM beats) SELECT subject_id, round(1 / median(d), 9) AS fs_hz FROM d GROUP BY 1")
def sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sample_rate(V.beats(spark, sf_dir), ["subject_id"]).withColumn("fs_hz", F.round("fs_hz", 9))


@query(f"WITH {V.SQL_BEATS} SELECT subject_id, round(max(t_s), 3) AS dur_s, arg_min(rr_ms, t_s) AS fs_hz, count(*) AS n_rows FROM beats GROUP BY 1")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.summary(V.beats(spark, sf_dir), ["subject_id"], "t_s", "rr_ms").withColumn("dur_s", F.round("dur_s", 3))


@query(f"WITH {V.SQL_BEATS} SELECT subject_id, seq FROM beats QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY t_s, seq) <= 10")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.preview(V.beats(spark, sf_dir), ["subject_id"], ["t_s", "seq"]).select("subject_id", "seq")


@query("SELECT p_brand AS subject_id, min(p_partkey) AS path, CASE WHEN p_size % 3 < 2 THEN 'rr' ELSE 'acc' END AS family FROM part GROUP BY 1, 3")
def first_file_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = F.when(F.col("p_size") % 3 == 0, "rr").when(F.col("p_size") % 3 == 1, "ppi").otherwise("acc")
    files = V.table(spark, sf_dir, "part").select(F.col("p_brand").alias("subject_id"), signal.alias("signal"), F.col("p_partkey").alias("path"))
    return I.first_wins(files).select("subject_id", "path", F.when(F.col("signal") == "acc", "acc").otherwise("rr").alias("family"))


@query(f"WITH {V.SQL_BEATS}, {V.SQL_BEATS2} SELECT subject_id, count(*) AS n, round(sum(rr_ms), 4) AS total FROM (SELECT CASE WHEN subject_id % 2 = 0 THEN subject_id ELSE -subject_id END AS subject_id, rr_ms FROM beats UNION ALL SELECT subject_id, rr_ms FROM beats2 WHERE subject_id % 2 = 1) GROUP BY 1")
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source knows odd subjects by other ids."""
    s = F.col("subject_id")
    first = V.beats(spark, sf_dir).withColumn("subject_id", F.when(s % 2 == 0, s).otherwise(-s))
    both = I.by_priority([first, V.beats2(spark, sf_dir)], ["subject_id"])
    return both.groupBy("subject_id").agg(F.count("*").alias("n"), F.round(F.sum("rr_ms"), 4).alias("total"))


@query("SELECT l_suppkey AS subject_id, count(*) AS n, round(sum(l_quantity), 4) AS x FROM lineitem GROUP BY 1")
def standard_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.acc(spark, sf_dir).withColumnsRenamed({"value_x": "X_mg", "value_y": "Y_mg", "value_z": "Z_mg"})
    return I.standard(raw, "acc").groupBy("subject_id").agg(F.count("*").alias("n"), F.round(F.sum("value_x"), 4).alias("x"))


@query("SELECT user_id AS subject_id, trim(event_type) AS events, count(*) AS n FROM events GROUP BY 1, 2")
def standard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.markers(spark, sf_dir).select("subject_id", "time_s", F.concat(F.lit(" "), "label", F.lit("  ")).alias("what"))
    return I.standard(raw, "events").groupBy("subject_id", "events").agg(F.count("*").alias("n"))


@query("SELECT user_id AS subject_id, count(*) AS n, round(sum(500 + 5 * value), 4) AS total FROM events WHERE event_id % 7 > 0 GROUP BY 1")
def standard_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("seq") % 7 == 0, "bad").otherwise(((F.col("rr_ms")) / 1000).cast("string"))
    raw = V.beats(spark, sf_dir).select("subject_id", "t_s", text.alias("rr_ms"))
    return I.standard(raw, "rr").groupBy("subject_id").agg(F.count("*").alias("n"), F.round(F.sum("rr_ms"), 4).alias("total"))
