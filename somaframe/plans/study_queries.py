"""Queries of sources, tasks, questionnaires' totals, covariates, and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somaframe.functions import names as N
from somaframe.functions.folders import new
from somaframe.functions.frames import in_time, running_total
from somaframe.operators import beats as B
from somaframe.operators import cleaning as C
from somaframe.operators import ingest as I
from somaframe.operators import mixed_model as M
from somaframe.operators import respiration as R
from somaframe.operators import scoring as S
from somaframe.operators import stats as D
from somaframe.operators import tables as T
from somaframe.operators import time_domain as TD
from somaframe.operators import windows as W
from somaframe.plans.beat_queries import IN_TIME, SQL_F, cut, rounded
from somaframe.plans.frequency_queries import SQL_RESP
from somaframe.plans.ingest_queries import SQL_NAMES, SQL_SID, file_names, sids
from somaframe.plans.registry import query
from somaframe.plans.signal_queries import KEYS, TEN_HZ
from somaframe.plans.table_queries import CALM, FOCUS, ITEMS, METRICS, SCALES, SQL_Z, items
from somaframe.plans.window_queries import SQL_DAYS, day_windows
from somaframe.sources import files as X
from somaframe.sources import records as RC
from somaframe.sources import sample_views as V

# --- sources: tables are written to a new shared folder and read back ---


@query("SELECT o_orderkey AS id, o_orderpriority AS priority, o_totalprice AS price FROM orders")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new(spark)
    X.write_csv(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    return X.read_csv(spark, path).select(F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("double").alias("price"))


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def csv_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by semicolons are told from the first line."""
    path = new(spark)
    V.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").write.csv(path, header=True, sep=";")
    return X.read_csv(spark, path).select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_mktsegment").alias("segment"))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new(spark)}.parquet"
    X.write_parquet(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, ["o_orderstatus"])
    return X.read_table(spark, path).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey AS subject_id, true AS absent FROM customer")
def table_if_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.read_table(spark, f"{sf_dir}/customer.parquet", {"c_custkey": "subject_id"})
    return found.select("subject_id", F.lit(X.read_table(spark, f"{new(spark)}.parquet") is None).alias("absent"))


@query("SELECT user_id AS subject_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def first_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first table lacks a column, the second has no time that is a number, the third has all."""
    rows = V.table(spark, sf_dir, "events").select("user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("time_s"))
    paths = [f"{new(spark)}.parquet", new(spark), f"{new(spark)}.parquet"]
    X.write_parquet(rows.select("user_id", "value"), paths[0])
    X.write_csv(rows.withColumn("time_s", F.lit("none")), paths[1])
    X.write_parquet(rows, paths[2])
    return X.read_first(spark, paths, ["user_id", "value"], "time_s").groupBy(F.col("user_id").cast("bigint").alias("subject_id")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))


@query("""WITH r AS (SELECT 'rec' || (event_id % 3) AS name, event_id AS i, value AS v FROM events) SELECT name, signal, round(i / 250.0::DOUBLE, 6) AS time_s, round(CASE signal WHEN 'ecg' THEN v ELSE -v END, 6) AS value, 250.0::DOUBLE AS fs_hz FROM r CROSS JOIN (VALUES ('ecg'), ('resp')) s(signal)""")
def records_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new(spark)}.parquet"
    X.write_parquet(V.table(spark, sf_dir, "events").select(F.concat(F.lit("rec"), F.col("event_id") % 3).alias("name"), F.col("event_id").alias("i"), F.col("value").alias("ECG II"), (-F.col("value")).alias("RESP belt")), path)
    return rounded(X.load("records", spark, folder=path, rate=250.0), "time_s", "value")


#: Measured values as two channels, one event in fifty missing; a record is a user's events in their order.
SQL_SAMPLES = "sm AS (SELECT 'r' || user_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE WHEN event_id % 50 <> 0 THEN value END AS v FROM events)"


@query(f"""WITH {SQL_SAMPLES}, fm AS (SELECT * FROM (VALUES (16, 32.0::DOUBLE), (212, 2.0::DOUBLE)) t(bits, gain)), ch AS (SELECT * FROM (VALUES ('ecg', 1), ('resp', -1)) t(signal, sgn))
    SELECT CAST(bits AS INTEGER) AS bits, name, signal, i, round(i / 250.0::DOUBLE, 6) AS time_s, round_even(sgn * v * gain, 0) / gain + 0.0 AS value, 250.0::DOUBLE AS fs_hz FROM sm CROSS JOIN fm CROSS JOIN ch""")
def binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as bytes of both formats, and read back by the data source, in parts of a few frames."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value = F.when(F.col("event_id") % 50 != 0, F.col("value"))
    samples = V.table(spark, sf_dir, "events").select(F.concat(F.lit("r"), "user_id").alias("name"), (F.row_number().over(order) - 1).cast("bigint").alias("i"), value.alias("ECG II"), (-value).alias("RESP belt"))
    parts = []
    for bits, gain in ((16, 32.0), (212, 2.0)):
        path = new(spark)
        RC.write_records(samples, path, 250.0, bits, gain, ["ECG II", "RESP belt"]).agg(F.sum("frames")).first()
        parts.append(X.load("binary_records", spark, folder=path, part_frames=30).withColumn("bits", F.lit(bits)))
    return rounded(parts[0].unionByName(parts[1]), "time_s").select("bits", "name", "signal", "i", "time_s", "value", "fs_hz")


@query(f"WITH {SQL_DAYS} SELECT subject_id, w_id, CAST(2 AS INTEGER) AS level, CAST(3 AS INTEGER) AS next_level FROM wins WHERE w_id % 2 = 0")
def level_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as level 1, every other one as level 2; level 2 is read alone."""
    base = new(spark)
    days = day_windows(spark, sf_dir).select("subject_id", "w_id")
    X.write_level(days, base)
    X.write_level(days.where("w_id % 2 = 0"), base)
    return X.read_levels(spark, base, [2]).select("subject_id", "w_id", "level", F.lit(X.levels(spark, base)[-1] + 1).alias("next_level"))


@query(f"""WITH {SQL_NAMES}, k AS (SELECT id, name, lower(name) AS n, p_size FROM names), s AS (SELECT *, CASE WHEN contains(n, 'ecg') THEN 'ecg' WHEN contains(n, 'rr') THEN 'rr' WHEN contains(n, 'heart_rate') THEN 'hr' WHEN contains(n, 'resp') THEN 'resp' WHEN contains(n, 'ppg') THEN 'ppg' WHEN contains(n, 'acc') THEN 'acc' WHEN contains(n, 'markers') THEN 'events' END AS kind FROM k)
    SELECT name, kind || CASE WHEN kind IN ('hr', 'acc') AND contains(n, 'h10') THEN 'h' WHEN kind IN ('hr', 'acc') AND contains(n, 'verity') THEN 'v' ELSE '' END AS signal, CASE WHEN kind IS NULL OR starts_with(n, 'plain') AND NOT regexp_matches(n, '[0-9]') THEN 'skip' ELSE 'found' END AS status, CAST(p_size AS BIGINT) AS bytes FROM s""")
def files_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = file_names(spark, sf_dir).select(F.concat(F.lit("/data/in/"), "name", F.lit(".csv")).alias("path"), F.col("p_size").cast("bigint").alias("bytes"))
    return X.described(files).select("name", "signal", "status", "bytes")


@query(f"WITH {SQL_NAMES} SELECT DISTINCT split_part(name, '_', 1) AS subject_id FROM names")
def subjects_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.subjects(file_names(spark, sf_dir))


SQL_GUESS = "SELECT '{t}' AS name, '{a}' AS time_column, '{b}' AS value_column, sum(CAST({a} AS HUGEINT) % 1000003)::BIGINT AS times, CAST(count(DISTINCT {b}) AS BIGINT) AS n_values FROM {t}"


@query(f"{SQL_GUESS.format(t='orders', a='o_orderkey', b='o_custkey')} UNION ALL {SQL_GUESS.format(t='region', a='r_regionkey', b='r_name')}")
def guessed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and value by position, the first two numeric columns, else the first two; and what is read by these names."""
    parts = []
    for name in ("orders", "region"):
        rows = V.table(spark, sf_dir, name)
        time, value = I.first_two_numeric(rows)
        parts.append(rows.agg(F.lit(name).alias("name"), F.lit(time).alias("time_column"), F.lit(value).alias("value_column"), F.sum(F.col(time) % 1000003).cast("bigint").alias("times"), F.count_distinct(value).alias("n_values")))
    return parts[0].unionByName(parts[1])


@query("SELECT l_suppkey AS subject_id, 'l_quantity' AS suggestion, round(sum(l_quantity), 3) AS total FROM lineitem GROUP BY 1")
def suggested_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A misspelt column, read by its suggestion."""
    lines = V.table(spark, sf_dir, "lineitem")
    name = I.suggested(lines.columns, "l_quantty")[0]
    return lines.groupBy(F.col("l_suppkey").alias("subject_id")).agg(F.lit(name).alias("suggestion"), F.round(F.sum(name), 3).alias("total"))


@query(f"""{SQL_F}, x AS (SELECT hr_bpm, hr_bpm - avg(hr_bpm) OVER p AS ws, avg(hr_bpm) OVER p AS bs, rmssd_ms FROM f WINDOW p AS (PARTITION BY subject_id)), y AS (SELECT unnest(['hr_bpm', 'hr_bpm_ws', 'hr_bpm_bs', 'rmssd_ms']) AS name, unnest([hr_bpm, ws, bs, rmssd_ms]) AS v FROM x)
    SELECT name, count(v) AS n, round(avg(abs(v)), 6) AS mean FROM y GROUP BY 1""")
def expanded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asked features of windows with their centred families, as far as the table has them."""
    rows = TD.centred(TD.features(cut(spark, sf_dir), ["hr_bpm", "rmssd_ms", "sdnn_ms"]), ["hr_bpm"])
    names = T.expanded(["hr_bpm", "rmssd_ms", "absent"], rows.columns)
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in names))).alias("x")).select("x.*")
    return long.groupBy("name").agg(F.count("v").alias("n"), F.round(F.avg(F.abs("v")), 6).alias("mean"))


@query("SELECT user_id AS subject_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 7 > 0 GROUP BY 1")
def standard_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, " NA ").otherwise(F.col("value").cast("string"))
    raw = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), F.col("event_id").cast("double").alias("t_s"), text.alias("bpm"))
    return I.standard(raw, "hr").where("bpm IS NOT NULL").groupBy("subject_id").agg(F.count("*").alias("n"), F.round(F.sum("bpm"), 4).alias("total"))


@query(f"WITH {SQL_SID} SELECT sid, user_id AS numeric_id FROM sids")
def numeric_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sids(spark, sf_dir).select("sid", N.numeric_id(F.col("sid")).alias("numeric_id"))


@query("SELECT p_partkey AS id, regexp_replace(p_name || ' (' || p_brand || ')', '[^0-9A-Za-z]+', '_', 'g') AS name FROM part")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.safe_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"))


@query(f"WITH {SQL_SID} SELECT sid FROM sids WHERE sid NOT IN ('P003S001T002R001') AND regexp_extract(sid, '(P\\d{{3}})', 1) NOT IN ('P007')")
def excluded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.without(sids(spark, sf_dir), ["P003S001T002R001", "P007"], F.col("sid"), N.short_label(F.col("sid"))).select("sid")


@query(f"WITH {SQL_DAYS} SELECT CAST(max(w_id % 4) + 1 AS INTEGER) AS level FROM wins")
def next_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.next_level(day_windows(spark, sf_dir).withColumn("level", F.col("w_id") % 4))


@query("SELECT l_suppkey AS subject_id, round(sum(sqrt(l_quantity ** 2 + (l_discount * 1000) ** 2)), 3) AS vm FROM lineitem GROUP BY 1")
def two_axis_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.acc(spark, sf_dir).groupBy("subject_id").agg(F.round(F.sum(TD.magnitude(z=None)), 3).alias("vm"))


# --- tasks and cleaning ---

SQL_DECISIONS = "dec AS (SELECT DISTINCT user_id AS subject_id, CASE user_id % 3 WHEN 0 THEN ' Device_RR' WHEN 1 THEN 'ecg_rr' ELSE 'none' END AS choice FROM events)"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    choice = F.when(u % 3 == 0, " Device_RR").when(u % 3 == 1, "ecg_rr").otherwise("none")
    return V.table(spark, sf_dir, "events").select(u.alias("subject_id"), choice.alias("choice")).distinct()


@query(f"WITH {SQL_DECISIONS} SELECT CAST(subject_id AS VARCHAR) AS subject_id, lower(trim(choice)) AS choice FROM dec WHERE choice <> 'none' AND subject_id % 7 = 0")
def cleaning_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a list of allowed ids, which is the feature: those that are divisible by seven."""
    top = decisions(spark, sf_dir).agg(F.max("subject_id")).first()[0]
    return B.cleaning_tasks(decisions(spark, sf_dir), [str(k) for k in range(0, top + 1, 7)])


@query(f"WITH {SQL_DECISIONS}, al AS (SELECT c_custkey AS subject_id FROM customer) SELECT CAST(al.subject_id AS VARCHAR) AS subject_id FROM al LEFT JOIN dec ON dec.subject_id = al.subject_id AND choice <> 'none' WHERE dec.subject_id IS NULL")
def not_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.not_cleaned(decisions(spark, sf_dir), V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id")))


@query(f"""WITH {V.SQL_BEATS}, o AS (SELECT *, CASE WHEN rr_ms BETWEEN 510 AND 2000 THEN rr_ms END AS x0, row_number() OVER w AS p FROM beats {IN_TIME}), v AS (SELECT *, p > 1 AND coalesce(abs(lag(x0) OVER w - x0) > 0.2 * lag(x0) OVER w, true) AS e FROM o {IN_TIME}),
    g AS (SELECT *, p - row_number() OVER (PARTITION BY subject_id, e ORDER BY t_s, seq) AS g FROM v), k AS (SELECT *, CASE WHEN NOT e OR row_number() OVER (PARTITION BY subject_id, e, g ORDER BY t_s, seq) % 2 = 0 THEN x0 END AS x FROM g),
    n AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0, first_value(x IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p1
        FROM k WINDOW b AS (PARTITION BY subject_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY subject_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT subject_id, seq, round(CASE WHEN seq % 3 = 0 THEN coalesce(x, v0 + (v1 - v0) * (p - p0) / (p1 - p0), v0) ELSE rr_ms END, 6) AS rr_ms FROM n""")
def ectopic_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third beat is marked."""
    return rounded(C.ectopic_refilled(V.beats(spark, sf_dir).withColumn("bad", F.col("seq") % 3 == 0)), "rr_ms").select("subject_id", "seq", "rr_ms")


# --- questionnaires ---


@query(f"{ITEMS} SELECT subject_id, time, ({CALM} + {FOCUS}) / 2 AS state FROM items")
def only_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scored(items(spark, sf_dir), SCALES, shown=S.shown(["calm", "focus", "state"], SCALES))


@query(f"{ITEMS} SELECT subject_id, time, {CALM} AS calm, {FOCUS} AS focus, ({CALM} + {FOCUS}) / 2 AS state FROM items")
def totals_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored table whose total is stale."""
    return S.totals_updated(S.scored(items(spark, sf_dir), SCALES).withColumn("state", F.lit(-1.0)), SCALES)


ASKED = {1: ["q1", "q2"], 2: ["q1"], 3: ["q1"]}


@query(f"""{ITEMS}, s AS (SELECT * FROM (VALUES ('time', '1'), ('time', '2'), ('time', '3'), ('repeated', 'q1'), ('all', 'q1'), ('all', 'q2')) t(kind, name))
    SELECT kind, name, (SELECT count(CASE WHEN kind = 'time' THEN CASE WHEN CAST(time AS VARCHAR) = name THEN 1 END ELSE CASE WHEN name = 'q1' THEN q1 ELSE q2 END END) FROM items) AS n FROM s""")
def variable_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times, constructs asked for repeatedly, and all, each with how many answers the questionnaires have."""
    times, repeated, every = S.variable_sets(ASKED)
    named = [*(("time", str(t), F.count_if(F.col("time") == t)) for t in times), *(("repeated", n, F.count(n)) for n in repeated), *(("all", n, F.count(n)) for n in every)]
    counts = items(spark, sf_dir).agg(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), n.alias("n")) for kind, name, n in named)).alias("x"))
    return counts.select(F.explode("x").alias("x")).select("x.*")


SQL_AT = "max(CASE WHEN time = {t} THEN q1 END) OVER (PARTITION BY items.subject_id)"


@query(f"""{ITEMS}, f AS (SELECT subject_id, arg_min(q2, time) FILTER (WHERE q2 IS NOT NULL) AS v FROM items GROUP BY 1), g AS (SELECT avg(v) AS m FROM f)
    SELECT subject_id, time, round(q2 - m, 6) AS q2_c, round((q2 - m) * task, 6) + 0.0 AS q2_inter, {SQL_AT.format(t=2)} - {SQL_AT.format(t=1)} AS q121, {SQL_AT.format(t=3)} - {SQL_AT.format(t=1)} AS q131, {SQL_AT.format(t=3)} - {SQL_AT.format(t=2)} AS q132 FROM items CROSS JOIN g""")
def post_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.post_operations(items(spark, sf_dir), ASKED, "task")
    return found.select("subject_id", "time", F.round("q2_c", 6).alias("q2_c"), (F.round("q2_inter", 6) + 0.0).alias("q2_inter"), "q121", "q131", "q132")


@query(f"""{SQL_Z}, own AS (SELECT subject_id, arg_min(q4, time) FILTER (WHERE q4 IS NOT NULL) AS q4 FROM items GROUP BY 1)
    SELECT l.subject_id, l.task, indicator, l.time, round(z, 6) AS z, i.q3, own.q4 FROM l LEFT JOIN items i ON i.subject_id = l.subject_id AND i.time = l.time + 1 LEFT JOIN own ON own.subject_id = l.subject_id""")
def zchange_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    return rounded(D.with_covariates(D.changes(rows, METRICS, "task", "time"), rows, ["q3"], ["q4"], "time"), "z")


# --- mixed models ---


@query(f"{ITEMS} SELECT subject_id, task, time, q1 FROM items WHERE NOT starts_with(CAST(subject_id AS VARCHAR), '1') AND NOT starts_with(CAST(subject_id AS VARCHAR), '27')")
def lmm_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without subjects whose ids have a prefix, which is the feature."""
    return M.prepared(items(spark, sf_dir), ["q1", "absent"], ["1", "27"], "task", "time")


@query()
def lmm_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine tables of two dependent variables below each other."""
    found = M.all_tables(items(spark, sf_dir), ["q1", "q2", "absent"], (), "task", "time")
    rows = pd.concat([t.assign(result=name) for name, t in found.items()], ignore_index=True)
    texts = ["result", "dv", "name", "term", "at"]
    rows[texts] = rows[texts].astype(object).where(rows[texts].notna(), None)
    kinds = ", ".join(f"`{c}` {'string' if c in texts else 'double'}" for c in rows.columns)
    return spark.createDataFrame(rows.astype({c: "float64" for c in rows.columns if c not in texts}), kinds)


# --- respiration ---


def two_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breath peaks laid out from beats, a new span every 150 seconds."""
    gap = F.when(F.col("seq") % 13 == 0, 12.0).otherwise(4 + (F.col("seq") % 5) * 1.5)
    order = Window.partitionBy("subject_id").orderBy("t_s", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return V.beats(spark, sf_dir).select("subject_id", F.sum(gap).over(order).alias("t_peak")).withColumn("span", F.floor(F.col("t_peak") / 150))


@query(f"""WITH {V.SQL_BEATS}, pk AS (SELECT subject_id, sum(CASE WHEN seq % 13 = 0 THEN 12.0::DOUBLE ELSE 4 + (seq % 5) * 1.5::DOUBLE END) OVER (PARTITION BY subject_id ORDER BY t_s, seq ROWS UNBOUNDED PRECEDING) AS t0 FROM beats),
    gp AS (SELECT *, t1 - t0 BETWEEN 2 AND 10 AS ok FROM (SELECT subject_id, floor(t0 / 150) AS span, t0, lead(t0) OVER (PARTITION BY subject_id, floor(t0 / 150) ORDER BY t0) AS t1 FROM pk) WHERE t1 IS NOT NULL),
    il AS (SELECT *, row_number() OVER (PARTITION BY subject_id, span ORDER BY t0) - row_number() OVER (PARTITION BY subject_id, span, ok ORDER BY t0) AS g FROM gp),
    ln AS (SELECT subject_id, span, g, count(*) AS n, min(t0) AS a FROM il WHERE ok GROUP BY 1, 2, 3), bs AS (SELECT subject_id, span, g FROM ln QUALIFY row_number() OVER (PARTITION BY subject_id, span ORDER BY n DESC, a) = 1),
    bre AS (SELECT il.subject_id, il.span, t0, t1 FROM il JOIN bs ON bs.subject_id = il.subject_id AND bs.span = il.span AND bs.g = il.g WHERE ok),
    bt AS (SELECT subject_id, rr_ms, sum(rr_ms) OVER (PARTITION BY subject_id ORDER BY t_s, seq ROWS UNBOUNDED PRECEDING) / 1000 AS t FROM beats),
    ea AS (SELECT bre.subject_id, span, bre.t0, max(rr_ms) - min(rr_ms) AS r FROM bre JOIN bt ON bt.subject_id = bre.subject_id AND t >= t0 AND t < t1 GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    sp AS (SELECT subject_id, span, avg(r) AS rsa, count(*) AS k FROM ea GROUP BY 1, 2 HAVING count(*) >= 2), rt AS (SELECT subject_id, span, 60 / median(t1 - t0) AS rate FROM bre GROUP BY 1, 2),
    ro AS (SELECT sp.subject_id, avg(rsa) AS rsa, median(rate) AS rate, sum(k) AS k FROM sp JOIN rt ON rt.subject_id = sp.subject_id AND rt.span = sp.span GROUP BY 1)
    SELECT su.subject_id, round(rsa, 6) AS rsa_ms, round(ln(rsa), 6) AS rsa_log_ms, round(rate, 6) AS resp_rate_bpm, CAST(coalesce(k, 0) AS BIGINT) AS n_breaths_used, CASE WHEN rsa IS NULL THEN 'unavailable' ELSE 'peak_to_valley' END AS rsa_method FROM (SELECT DISTINCT subject_id FROM bre) su LEFT JOIN ro ON ro.subject_id = su.subject_id""")
def rsa_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = V.beats(spark, sf_dir).withColumn("t_s", running_total("rr_ms", in_time()) / 1000)
    found = R.window_arrhythmia(R.breaths(two_spans(spark, sf_dir), KEYS), beats, keys=KEYS)
    return rounded(found, "rsa_ms", "rsa_log_ms", "resp_rate_bpm").drop("resp_amp", "resp_log_amp")


REPORTED = ("time_median_dt", "duration_s", "time_gap_frac", "time_median_dt_dev", "ptp_raw_p95p5", "clip_frac_all", "flat_frac_all")
SQL_LONGEST = "(SELECT subject_id, max(n) AS m FROM (SELECT subject_id, {f}, g, CASE WHEN {f} THEN count(*) ELSE 0 END AS n FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY seq) - row_number() OVER (PARTITION BY subject_id, {f} ORDER BY seq) AS g FROM fl) GROUP BY 1, 2, 3) GROUP BY 1)"


@query(f"""WITH {SQL_RESP}, st AS (SELECT *, time_s - lag(time_s) OVER w AS d, value - lag(value) OVER w AS x, lead(value) OVER w - value AS y FROM resp WINDOW w AS (PARTITION BY subject_id ORDER BY seq)), ty AS (SELECT subject_id, median(d) FILTER (WHERE d > 0) AS dt FROM st GROUP BY 1),
    fl AS (SELECT st.*, dt, coalesce(value <= 1 OR value >= 1022, false) AS c, coalesce(abs(x) <= 1, false) OR coalesce(abs(y) <= 1, false) AS f FROM st JOIN ty ON ty.subject_id = st.subject_id),
    ag AS (SELECT subject_id, count(*) AS n_rows, count(*) - count(value) AS n_holes, any_value(dt) AS time_median_dt, max(time_s) - min(time_s) AS duration_s, avg(CASE WHEN d IS NOT NULL THEN CASE WHEN d <= 0 OR d > 3 * dt THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS time_gap_frac, median(abs(d - dt)) AS time_median_dt_dev,
        quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS ptp_raw_p95p5, avg(CASE WHEN c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS clip_frac_all, avg(CASE WHEN f THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS flat_frac_all FROM fl GROUP BY 1)
    SELECT ag.subject_id, n_rows, n_holes, {", ".join(f"round({c}, 6) AS {c}" for c in REPORTED)}, lc.m AS clip_max_run_all, lf.m AS flat_max_run_all FROM ag JOIN {SQL_LONGEST.format(f="c")} lc ON lc.subject_id = ag.subject_id JOIN {SQL_LONGEST.format(f="f")} lf ON lf.subject_id = ag.subject_id""")
def resp_signal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.signal_report(V.resp(spark, sf_dir), KEYS, rules=TEN_HZ), *REPORTED)


@query()
def resp_full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    resp = V.resp(spark, sf_dir)
    expected = resp.groupBy("subject_id").agg((F.max("time_s") - F.min("time_s")).alias("expected_duration_s"))
    return R.full_report(resp, None, expected, KEYS, TEN_HZ)
