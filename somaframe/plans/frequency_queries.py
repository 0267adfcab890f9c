"""Queries of the frequency-domain operators. Windows here are all beats of a user; 60 of them last about a minute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaframe.operators import frequency as Q
from somaframe.plans.registry import query
from somaframe.sources import sample_views as V

SQL_TACHO = f"""WITH {V.SQL_BEATS}, r AS (SELECT *, sum(rr_ms) OVER (PARTITION BY subject_id ORDER BY t_s, seq ROWS UNBOUNDED PRECEDING) / 1000 AS c FROM beats),
    t AS (SELECT *, c - min(c) OVER (PARTITION BY subject_id) AS t, count(*) OVER (PARTITION BY subject_id) AS nb FROM r),
    u AS (SELECT *, lead(t) OVER w AS t1, lead(rr_ms) OVER w AS v1, CAST(ceil(max(t) OVER (PARTITION BY subject_id) * 4) AS BIGINT) AS np FROM t WINDOW w AS (PARTITION BY subject_id ORDER BY t_s, seq)),
    e AS (SELECT *, unnest(range(CAST(ceil(t * 4) AS BIGINT), CAST(ceil(t1 * 4) AS BIGINT))) AS n FROM u WHERE nb >= 3 AND np >= 16 AND t1 > t),
    grid AS (SELECT subject_id, n, rr_ms + (v1 - rr_ms) * (n / 4.0::DOUBLE - t) / (t1 - t) AS x FROM e)"""
SQL_PSD = """sz AS (SELECT *, least(count(*) OVER (PARTITION BY subject_id), {seg}) AS sz, count(*) OVER (PARTITION BY subject_id) AS al FROM {grid}), hp AS (SELECT *, sz - sz // 2 AS hop, (al - sz // 2) // (sz - sz // 2) AS ns FROM sz),
    mb AS (SELECT *, n - s * hop AS i FROM (SELECT *, unnest([n // hop - 1, n // hop]) AS s FROM hp) WHERE s >= 0 AND s < ns AND n - s * hop < sz),
    tr AS (SELECT subject_id, s, regr_slope(x, i) AS b, regr_intercept(x, i) AS a, avg(x) AS m FROM mb GROUP BY 1, 2),
    fl AS (SELECT mb.subject_id, mb.s, i, sz, x - ({trend}) AS y, 0.5 - 0.5 * cos(2 * pi() * i / sz) AS w FROM mb JOIN tr ON tr.subject_id = mb.subject_id AND tr.s = mb.s),
    kk AS (SELECT *, unnest(range(0, CAST(floor(0.5 * sz / {rate}) AS BIGINT) + 1)) AS k FROM fl),
    sm AS (SELECT subject_id, s, k, first(sz) AS sz, sum(y * w * cos(2 * pi() * ((k * i) % sz) / sz)) AS re, sum(y * w * sin(2 * pi() * ((k * i) % sz) / sz)) AS im, sum(w * w) AS ww FROM kk GROUP BY 1, 2, 3),
    psd AS (SELECT subject_id, k, first(k * {rate}::DOUBLE / sz) AS hz, avg(CASE WHEN k = 0 OR 2 * k = sz THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END * (re * re + im * im) / ({rate} * ww)) AS power FROM sm GROUP BY 1, 2)"""
SQL_DENSITY = f"{SQL_TACHO}, {SQL_PSD.format(seg=256, rate=4, trend='a + b * i', grid='grid')}"
SQL_NEXT = "nx AS (SELECT *, lead(hz) OVER w AS h1, lead(power) OVER w AS p1 FROM psd WINDOW w AS (PARTITION BY subject_id ORDER BY k))"
AREA = "sum(CASE WHEN hz >= {lo} AND h1 <= {hi} THEN (power + p1) / 2 * (h1 - hz) END)"
WHOLE = ["subject_id"]


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.spectrum(Q.tachogram(V.beats(spark, sf_dir), keys=WHOLE), keys=WHOLE)


@query(f"{SQL_TACHO} SELECT subject_id, n, round(x, 5) AS x FROM grid")
def tachogram_4hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.tachogram(V.beats(spark, sf_dir), keys=WHOLE).withColumn("x", F.round("x", 5))


@query(f"{SQL_DENSITY} SELECT subject_id, k, round(hz, 6) AS hz, round(power, 3) AS power FROM psd")
def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density(spark, sf_dir).withColumns({"hz": F.round("hz", 6), "power": F.round("power", 3)})


@query(f"{SQL_DENSITY}, {SQL_NEXT}, bp AS (SELECT subject_id, {AREA.format(lo=0.04, hi=0.15)} AS lf, {AREA.format(lo='0.15 - 1e-9', hi='0.40 + 1e-9')} AS hf FROM nx GROUP BY 1) SELECT subject_id, round(lf, 3) AS lf_ms2, round(ln(lf), 6) AS lf_log_ms2, round(hf, 3) AS hf_ms2, round(ln(hf), 6) AS hf_log_ms2 FROM bp")
def psd_band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.band_powers(density(spark, sf_dir), keys=WHOLE)
    return found.select("subject_id", *(F.round(c, 3 if "log" not in c else 6).alias(c) for c in ("lf_ms2", "lf_log_ms2", "hf_ms2", "hf_log_ms2")))


@query(f"""{SQL_DENSITY}, {SQL_NEXT}, f AS (SELECT *, 0.1 + (subject_id % 10) * 0.04 AS f0 FROM nx), g AS (SELECT *, f0 BETWEEN 0.15 AND 0.40 AS own, least(greatest(f0 - 0.05, 0.15), 0.30) AS a FROM f),
    h AS (SELECT *, CASE WHEN own THEN a ELSE 0.15 END AS lo, CASE WHEN own THEN a + 0.10 ELSE 0.40 END AS hi FROM g)
    SELECT subject_id, round({AREA.format(lo='lo - 1e-9', hi='hi + 1e-9')}, 3) AS hf_ms2, round(first(CASE WHEN own THEN (lo + hi) / 2 END), 6) AS hf_center_hz, first(CASE WHEN own THEN 'individual' ELSE 'fixed' END) AS hf_band_used FROM h GROUP BY 1""")
def hf_individual_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = density(spark, sf_dir)
    breath = rows.select("subject_id").distinct().withColumn("f0", 0.1 + (F.col("subject_id") % 10) * 0.04)
    found = Q.band_powers(rows, breath, keys=WHOLE)
    return found.select("subject_id", F.round("hf_ms2", 3).alias("hf_ms2"), F.round("hf_center_hz", 6).alias("hf_center_hz"), "hf_band_used")


SQL_RESP = """resp AS (SELECT subject_id, i AS seq, i / 10.0::DOUBLE AS time_s, CASE WHEN NOT (i % 400 BETWEEN 0 AND 20) THEN 100 * sin(2 * pi() * (0.2 + (subject_id % 5) * 0.03) * i / 10) END AS value
    FROM (SELECT DISTINCT user_id AS subject_id FROM events) u CROSS JOIN range(0, 1200) r(i))"""
SQL_HOLES = "ho AS (SELECT *, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY time_s ROWS UNBOUNDED PRECEDING) AS run FROM resp), ru AS (SELECT subject_id, run, count(*) AS n FROM ho WHERE value IS NOT NULL GROUP BY 1, 2)"


@query(f"""WITH {SQL_RESP}, {SQL_HOLES}, be AS (SELECT subject_id, run FROM ru QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, run) = 1),
    gr AS (SELECT ho.subject_id, row_number() OVER (PARTITION BY ho.subject_id ORDER BY time_s) - 1 AS n, value AS x FROM ho JOIN be ON be.subject_id = ho.subject_id AND be.run = ho.run WHERE value IS NOT NULL), {SQL_PSD.format(seg=512, rate=10, trend='m', grid='gr')}
    SELECT subject_id, round(arg_max(hz, power), 6) AS f0 FROM psd WHERE hz BETWEEN 0.1 AND 0.5 GROUP BY 1""")
def resp_peak_hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.breath_peak(V.resp(spark, sf_dir), WHOLE, rate=10.0).withColumn("f0", F.round("f0", 6))
