"""Queries of respiration cleaning over waves whose breaths have measured depths, with SQL that filters, finds peaks and judges on its own.

Each event is one breath, as deep as its value. Deep breaths are clipped, so that they have plateaus; runs of flat breaths
collapse; every 31st breath is a hole; of every fifth user all breaths are too shallow. Times are multiples of 1/8 s, so that
steps and rates are exact on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somaframe.config import BreathRules
from somaframe.functions import kernels as K
from somaframe.functions.frames import spread
from somaframe.functions.pieces import Pieces
from somaframe.operators import respiration as R
from somaframe.plans.beat_queries import rounded
from somaframe.plans.registry import query
from somaframe.sources import sample_views as V

KEYS = ["subject_id"]
RULES = BreathRules(rate=8.0)


def breathing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, seq, time_s, value"""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    dealt = spread(V.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id")  # the few events, not their samples
    events = dealt.select(F.col("user_id").alias("subject_id"), "value", (F.row_number().over(order) - 1).cast("bigint").alias("k"), (24 + 8 * (F.col("user_id") % 4)).alias("p"))
    depth = F.when(F.col("subject_id") % 5 == 4, 8.0).when((F.col("k") % 23).between(9, 12), 2.0).otherwise(60 + F.col("value"))
    wave = F.least(F.greatest(F.round(512 + depth * F.sin(2 * F.pi() * F.col("j") / F.col("p"))), F.lit(0.0)), F.lit(800.0))
    rows = events.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("p") - 1)))
    rows = rows.withColumns({"seq": F.col("k") * F.col("p") + F.col("j"), "value": F.when(F.col("k") % 31 != 30, wave)})
    return rows.select("subject_id", "seq", (F.col("seq") / 8).alias("time_s"), "value")


SQL_BREATHING = """ev AS (SELECT user_id AS subject_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, 24 + 8 * (user_id % 4) AS p FROM events),
    ej AS (SELECT *, unnest(range(0, p)) AS j, CASE WHEN subject_id % 5 = 4 THEN 8.0::DOUBLE WHEN k % 23 BETWEEN 9 AND 12 THEN 2.0::DOUBLE ELSE 60 + value END AS depth FROM ev),
    resp AS (SELECT subject_id, k * p + j AS seq, (k * p + j) / 8.0::DOUBLE AS time_s, CASE WHEN k % 31 <> 30 THEN least(greatest(round(512 + depth * sin(2 * pi() * j / p)), 0.0::DOUBLE), 800.0::DOUBLE) END AS value FROM ej)"""
#: Spans between holes, what has collapsed in them (a range of 10 at most over 8 seconds, for 2 seconds), and what is left, numbered. Here
#: time has no gaps.
SQL_STRETCHES = f"""{SQL_BREATHING}, br AS (SELECT *, value IS NULL AS b, lag(value IS NULL) OVER w AS pb FROM resp WINDOW w AS (PARTITION BY subject_id ORDER BY seq)),
    sp AS (SELECT *, CASE WHEN NOT b THEN sum(CASE WHEN NOT b AND coalesce(pb, true) THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY seq ROWS UNBOUNDED PRECEDING) END AS span FROM br),
    rg AS (SELECT *, span IS NOT NULL AND count(*) OVER f >= 16 AND max(value) OVER f - min(value) OVER f <= 10 AS flat FROM sp WINDOW f AS (PARTITION BY subject_id, span ORDER BY seq ROWS BETWEEN 32 PRECEDING AND 31 FOLLOWING)),
    fg AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY seq) - row_number() OVER (PARTITION BY subject_id, flat ORDER BY seq) AS g FROM rg),
    lf AS (SELECT subject_id, seq, time_s, value, span IS NOT NULL AND NOT (flat AND count(*) OVER (PARTITION BY subject_id, flat, g) >= 16) AS l FROM fg),
    lg AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY seq) - row_number() OVER (PARTITION BY subject_id, l ORDER BY seq) AS g FROM lf),
    al AS (SELECT *, l AND count(*) OVER (PARTITION BY subject_id, l, g) >= 5 AS alive FROM lg),
    sr AS (SELECT *, CASE WHEN alive THEN sum(CASE WHEN alive AND NOT coalesce(pa, false) THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY seq ROWS UNBOUNDED PRECEDING) ELSE 0 END AS stretch FROM (SELECT *, lag(alive) OVER (PARTITION BY subject_id ORDER BY seq) AS pa FROM al))"""


@query(f"WITH {SQL_STRETCHES} SELECT subject_id, seq, alive FROM al")
def breath_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trimmed(breathing(spark, sf_dir), KEYS, RULES).select("subject_id", "seq", "alive")


_B, _A = (x.tolist() for x in K.band_pass(3, *RULES.band, RULES.rate))
_Z = K.steady_state(*K.band_pass(3, *RULES.band, RULES.rate)).tolist()
_STEP = f"{_B[0]!r}::DOUBLE * p.x + f.z1"
_STATES = ", ".join(f"{f'f.z{k + 1} + ' if k < 6 else ''}{_B[k]!r}::DOUBLE * p.x - ({_A[k]!r}::DOUBLE) * ({_STEP}) AS z{k}" for k in range(1, 7))
_BEGIN = ", ".join(f"{f'{_Z[k]!r}::DOUBLE * x + ' if k < 6 else ''}{_B[k]!r}::DOUBLE * x - ({_A[k]!r}::DOUBLE) * ({_B[0]!r}::DOUBLE * x + {_Z[0]!r}::DOUBLE * x) AS z{k}" for k in range(1, 7))


def _sql_filter(name: str, source: str) -> str:
    """Recursive: the direct form, sample by sample from the first on, in the steady state of the first sample; source: subject_id, stretch, i, x."""
    return f"""{name} AS (SELECT subject_id, stretch, i, {_B[0]!r}::DOUBLE * x + {_Z[0]!r}::DOUBLE * x AS y, {_BEGIN} FROM {source} WHERE i = 0
    UNION ALL SELECT p.subject_id, p.stretch, p.i, {_STEP} AS y, {_STATES} FROM {name} f JOIN {source} p ON p.subject_id = f.subject_id AND p.stretch = f.stretch AND p.i = f.i + 1)"""


#: Stretches long and deep enough to be filtered, less their median, with 21 mirrored samples at each end; filtered forward and backward.
SQL_FILTERED = f"""{SQL_STRETCHES}, ss AS (SELECT subject_id, stretch, count(*) AS n, max(time_s) - min(time_s) AS seconds, quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS raw, median(value) AS m FROM sr WHERE stretch > 0 GROUP BY 1, 2),
    xs AS (SELECT sr.subject_id, sr.stretch, sr.seq, sr.time_s, value, n, row_number() OVER (PARTITION BY sr.subject_id, sr.stretch ORDER BY seq) - 1 AS i, value - m AS x FROM sr JOIN ss ON ss.subject_id = sr.subject_id AND ss.stretch = sr.stretch WHERE seconds >= 12 AND raw >= 20),
    en AS (SELECT subject_id, stretch, any_value(n) AS n, max(x) FILTER (WHERE i = 0) AS x0, max(x) FILTER (WHERE i = n - 1) AS x1 FROM xs GROUP BY 1, 2),
    pd AS MATERIALIZED (SELECT subject_id, stretch, i + 21 AS i, x FROM xs
        UNION ALL SELECT xs.subject_id, xs.stretch, 21 - i, 2 * x0 - x FROM xs JOIN en ON en.subject_id = xs.subject_id AND en.stretch = xs.stretch WHERE i BETWEEN 1 AND 21
        UNION ALL SELECT xs.subject_id, xs.stretch, 21 + 2 * (en.n - 1) - i, 2 * x1 - x FROM xs JOIN en ON en.subject_id = xs.subject_id AND en.stretch = xs.stretch WHERE i BETWEEN en.n - 22 AND en.n - 2),
    {_sql_filter('fw', 'pd')},
    rv AS MATERIALIZED (SELECT fw.subject_id, fw.stretch, n + 41 - i AS i, y AS x FROM fw JOIN en ON en.subject_id = fw.subject_id AND en.stretch = fw.stretch),
    {_sql_filter('bw', 'rv')},
    fl AS MATERIALIZED (SELECT xs.subject_id, xs.stretch, xs.seq, xs.time_s, xs.value, xs.i, xs.n, y FROM bw JOIN en ON en.subject_id = bw.subject_id AND en.stretch = bw.stretch JOIN xs ON xs.subject_id = bw.subject_id AND xs.stretch = bw.stretch AND xs.i = en.n + 20 - bw.i)"""


@query(f"WITH RECURSIVE {SQL_FILTERED} SELECT subject_id, seq, stretch::BIGINT AS stretch, round(y, 2) + 0.0 AS y FROM fl")
def breath_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.filtered(breathing(spark, sf_dir), KEYS, RULES)
    return found.select("subject_id", "seq", "stretch", (F.round("y", 2) + 0.0).alias("y"))


#: Welch's spectrum of each filtered stretch in segments of 20 seconds; its strongest bin from 0.1 to 0.5 Hz, over their mean and median.
SQL_GATE = f"""{SQL_FILTERED}, fp AS (SELECT subject_id, stretch, quantile_cont(y, 0.95) - quantile_cont(y, 0.05) AS wide FROM fl GROUP BY 1, 2),
    sg AS (SELECT *, least(n, 160) AS sz, unnest(range(0, n // (least(n, 160) - least(n, 160) // 2) + 1)) AS s FROM fl),
    sm AS (SELECT *, i - s * (sz - sz // 2) AS q FROM sg WHERE s * (sz - sz // 2) + sz <= n AND i BETWEEN s * (sz - sz // 2) AND s * (sz - sz // 2) + sz - 1),
    sw AS (SELECT *, (y - avg(y) OVER (PARTITION BY subject_id, stretch, s)) * (0.5 - 0.5 * cos(2 * pi() * q / sz)) AS u, 0.5 - 0.5 * cos(2 * pi() * q / sz) AS w FROM sm),
    dk AS (SELECT *, unnest(range(0, sz // 16 + 1)) AS k FROM sw),
    dt AS (SELECT subject_id, stretch, s, k, any_value(sz) AS sz, sum(u * cos(2 * pi() * ((k * q) % sz) / sz)) AS re, sum(u * sin(2 * pi() * ((k * q) % sz) / sz)) AS im, sum(w * w) AS ww FROM dk GROUP BY 1, 2, 3, 4),
    pw AS (SELECT subject_id, stretch, k, any_value(k * 8.0::DOUBLE / sz) AS hz, avg((re * re + im * im) / (8 * ww) * CASE WHEN k = 0 OR 2 * k = sz THEN 1 ELSE 2 END) AS power FROM dt GROUP BY 1, 2, 3),
    bd AS (SELECT subject_id, stretch, arg_max(hz, power) AS peak_hz, max(power) / avg(power) AS ratio, (max(power) - median(power)) / greatest(median(power), 1e-12) AS prominence FROM pw WHERE hz BETWEEN 0.1 AND 0.5 GROUP BY 1, 2),
    ex AS (SELECT *, CASE WHEN y > lag(y) OVER w AND y > lead(y) OVER w THEN 1 WHEN y < lag(y) OVER w AND y < lead(y) OVER w THEN -1 END AS side FROM fl WINDOW w AS (PARTITION BY subject_id, stretch ORDER BY seq)),
    eg AS (SELECT ex.*, floor(least(greatest(0.5 / peak_hz, 1), 4) * 8) AS gap FROM ex JOIN bd ON bd.subject_id = ex.subject_id AND bd.stretch = ex.stretch WHERE side IS NOT NULL),
    en2 AS (SELECT * FROM eg e WHERE NOT EXISTS (SELECT 1 FROM eg d WHERE d.subject_id = e.subject_id AND d.stretch = e.stretch AND d.side = e.side AND d.i <> e.i AND abs(d.i - e.i) < e.gap AND d.y * d.side > e.y * e.side)),
    sd AS (SELECT subject_id, stretch, CASE WHEN count(*) FILTER (WHERE side = 1) >= count(*) FILTER (WHERE side = -1) THEN 1 ELSE -1 END AS side FROM en2 GROUP BY 1, 2),
    pe AS (SELECT en2.subject_id, en2.stretch, time_s - lag(time_s) OVER (PARTITION BY en2.subject_id, en2.stretch ORDER BY seq) AS d FROM en2 JOIN sd ON sd.subject_id = en2.subject_id AND sd.stretch = en2.stretch AND sd.side = en2.side),
    pq AS (SELECT subject_id, stretch, count(*) - 1 AS cycles, quantile_cont(d, 0.1) AS lo, quantile_cont(d, 0.9) AS hi, count(d) AS nd FROM pe GROUP BY 1, 2),
    ps AS (SELECT pe.*, d BETWEEN lo AND hi AS inside, nd, count(*) FILTER (WHERE d BETWEEN lo AND hi) OVER (PARTITION BY pe.subject_id, pe.stretch) AS ni FROM pe JOIN pq ON pq.subject_id = pe.subject_id AND pq.stretch = pe.stretch WHERE d IS NOT NULL),
    pr AS (SELECT * FROM ps WHERE nd < 10 OR ni < 3 OR inside),
    pm AS (SELECT subject_id, stretch, median(d) AS mid, stddev_pop(d) AS sdv FROM pr GROUP BY 1, 2),
    pv AS (SELECT pr.subject_id, pr.stretch, any_value(mid) AS mid, greatest(any_value(sdv) / any_value(mid), 1.4826 * median(abs(d - mid)) / any_value(mid)) AS cv FROM pr JOIN pm ON pm.subject_id = pr.subject_id AND pm.stretch = pr.stretch GROUP BY 1, 2),
    gt AS (SELECT ss.subject_id, ss.stretch, ss.n, seconds, peak_hz, ratio, prominence, cycles::DOUBLE AS cycles, cv, 60 / mid AS bpm,
        CASE WHEN seconds < 12 THEN 'too_short' WHEN raw < 20 THEN 'raw_flat' WHEN wide < 2 THEN 'filtered_flat' WHEN cycles < 2 THEN 'too_few_cycles' WHEN ratio < 0.2 THEN 'psd_ratio'
            WHEN prominence < 1 AND NOT (cycles >= 6 AND cv <= 0.25 AND abs(60 / mid - 60 * peak_hz) <= 6) THEN 'psd_prominence' WHEN NOT 60 / mid BETWEEN 6 AND 30 THEN 'bpm_out_of_band' WHEN cv > 0.4 THEN 'irregular' WHEN abs(60 / mid - 60 * peak_hz) > 6 THEN 'disagreement' ELSE 'ok' END AS verdict
        FROM ss LEFT JOIN fp ON fp.subject_id = ss.subject_id AND fp.stretch = ss.stretch LEFT JOIN bd ON bd.subject_id = ss.subject_id AND bd.stretch = ss.stretch LEFT JOIN pq ON pq.subject_id = ss.subject_id AND pq.stretch = ss.stretch LEFT JOIN pv ON pv.subject_id = ss.subject_id AND pv.stretch = ss.stretch),
    wn AS (SELECT subject_id, count(*) AS n FROM resp GROUP BY 1),
    kp AS (SELECT subject_id, sum(n) AS good, sum(seconds) AS kept_s, median(peak_hz) AS peak_hz, median(ratio) AS ratio, median(prominence) AS prominence, median(cv) AS cv, median(cycles) AS cycles, median(bpm) AS bpm FROM gt WHERE verdict = 'ok' GROUP BY 1),
    rp AS (SELECT wn.subject_id, CASE WHEN good IS NULL OR kept_s < 12 THEN 'reject' WHEN good >= 0.95 * wn.n THEN 'ok' ELSE 'partial' END AS status, CASE WHEN good IS NULL THEN 'no_physio_rhythm' WHEN kept_s < 12 THEN 'no_valid_span' WHEN good < 0.95 * wn.n THEN 'trimmed' END AS reason,
        peak_hz, ratio, prominence, cv, cycles, bpm, wn.n FROM wn LEFT JOIN kp ON kp.subject_id = wn.subject_id)"""
FIGURES = ("peak_hz", "ratio", "prominence", "cv", "cycles", "bpm")
_ROUNDED = ", ".join(f"round({f}, 4) AS {f}" for f in FIGURES)


@query(f"WITH RECURSIVE {SQL_GATE} SELECT subject_id, stretch::BIGINT AS stretch, verdict, {_ROUNDED} FROM gt")
def breath_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch with its verdict and what was measured of it."""
    return rounded(R.judged(breathing(spark, sf_dir), KEYS, RULES), *FIGURES, digits=4).select("subject_id", "stretch", "verdict", *FIGURES)


@query(f"""WITH RECURSIVE {SQL_GATE}, kx AS (SELECT sr.subject_id, sr.stretch, min(time_s) AS t0, max(time_s) AS t1, count(*) AS k FROM sr JOIN gt ON gt.subject_id = sr.subject_id AND gt.stretch = sr.stretch AND verdict = 'ok' GROUP BY 1, 2),
    ks AS (SELECT kx.subject_id, count(*) AS spans, sum(t1 - t0) AS seconds, sum(k) AS k FROM kx JOIN rp ON rp.subject_id = kx.subject_id AND status <> 'reject' GROUP BY 1)
    SELECT rp.subject_id, status, reason, {_ROUNDED}, round(coalesce(k, 0) / n, 6) AS kept_share, coalesce(spans, 0)::BIGINT AS n_spans, coalesce(seconds, 0.0::DOUBLE) AS kept_s FROM rp LEFT JOIN ks ON ks.subject_id = rp.subject_id""")
def breath_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.reports(breathing(spark, sf_dir), KEYS, RULES)
    seconds = F.aggregate("kept_spans", F.lit(0.0), lambda acc, s: acc + s.t1 - s.t0)
    return rounded(rounded(found, *FIGURES, digits=4), "kept_share").select("subject_id", "status", "reason", *FIGURES, "kept_share", F.size("kept_spans").cast("bigint").alias("n_spans"), seconds.alias("kept_s"))


#: Flat tops: the longest run within one of the highest value, at most 0.6 s from a peak; all of it but its middle is lowered by one.
SQL_CLEAN = f"""{SQL_GATE}, kv AS (SELECT sr.subject_id, sr.stretch, seq, time_s, value FROM sr JOIN gt ON gt.subject_id = sr.subject_id AND gt.stretch = sr.stretch AND verdict = 'ok' JOIN rp ON rp.subject_id = sr.subject_id AND status <> 'reject'),
    ch AS (SELECT *, sum(CASE WHEN value IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, stretch ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(value) OVER (PARTITION BY subject_id, stretch ORDER BY seq) AS pv FROM kv)),
    tp AS (SELECT subject_id, stretch, g, any_value(value) AS v, min(seq) AS a, max(seq) AS b FROM ch GROUP BY 1, 2, 3),
    tk AS (SELECT subject_id, stretch, (a + b) // 2 AS p FROM tp WINDOW w AS (PARTITION BY subject_id, stretch ORDER BY g) QUALIFY v > lag(v) OVER w AND v > lead(v) OVER w),
    nr AS (SELECT kv.subject_id, kv.stretch, p, seq, value >= max(value) OVER (PARTITION BY kv.subject_id, kv.stretch, p) - 1 AS high FROM tk JOIN kv ON kv.subject_id = tk.subject_id AND kv.stretch = tk.stretch AND seq BETWEEN p - 4 AND p + 4),
    ng AS (SELECT *, seq - row_number() OVER (PARTITION BY subject_id, stretch, p ORDER BY seq) AS g FROM nr WHERE high),
    nl AS (SELECT subject_id, stretch, p, g, min(seq) AS a, max(seq) AS b FROM ng GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY subject_id, stretch, p ORDER BY max(seq) - min(seq) DESC, min(seq)) = 1),
    lw AS (SELECT DISTINCT kv.subject_id, kv.seq FROM nl JOIN kv ON kv.subject_id = nl.subject_id AND kv.stretch = nl.stretch AND kv.seq BETWEEN a AND b WHERE b > a AND kv.seq <> a + (b - a + 1) // 2)"""


@query(f"WITH RECURSIVE {SQL_CLEAN} SELECT resp.subject_id, resp.seq, CASE WHEN lw.seq IS NOT NULL THEN greatest(0.0::DOUBLE, kv.value - 1) ELSE kv.value END AS value FROM resp LEFT JOIN kv ON kv.subject_id = resp.subject_id AND kv.seq = resp.seq LEFT JOIN lw ON lw.subject_id = resp.subject_id AND lw.seq = resp.seq")
def breath_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cleaned(breathing(spark, sf_dir), KEYS, RULES).select("subject_id", "seq", "value")


@query(f"WITH RECURSIVE {SQL_GATE}, kx AS (SELECT sr.subject_id, min(time_s) AS t0, max(time_s) AS t1 FROM sr JOIN gt ON gt.subject_id = sr.subject_id AND gt.stretch = sr.stretch AND verdict = 'ok' JOIN rp ON rp.subject_id = sr.subject_id AND status <> 'reject' GROUP BY sr.subject_id, sr.stretch) SELECT resp.subject_id, seq, CASE WHEN EXISTS (SELECT 1 FROM kx WHERE kx.subject_id = resp.subject_id AND resp.time_s BETWEEN t0 AND t1) THEN value END AS value FROM resp")
def breath_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    resp = breathing(spark, sf_dir)
    return R.masked(resp, R.reports(resp, KEYS, RULES), KEYS).select("subject_id", "seq", "value")


#: Peaks of the wave under a mean of five samples (missing ones count as zero at the ends of a span), of the side with more of them: at least a
#: tenth of the quartile range above the higher of the lowest points on the way to a higher sample.
SQL_BREATHS = f"""{SQL_STRETCHES}, sq AS (SELECT subject_id, span, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM sp WHERE span IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5),
    mv AS (SELECT sp.subject_id, sp.span, seq, time_s, sum(value) OVER (PARTITION BY sp.subject_id, sp.span ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS y, iqr FROM sp JOIN sq ON sq.subject_id = sp.subject_id AND sq.span = sp.span WHERE iqr > 1e-6),
    sides AS (SELECT * FROM (VALUES (1), (-1)) t(side)), mw AS (SELECT mv.*, side, side * y AS v FROM mv CROSS JOIN sides),
    cg AS (SELECT *, sum(CASE WHEN v IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, span, side ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(v) OVER (PARTITION BY subject_id, span, side ORDER BY seq) AS pv FROM mw)),
    ct AS (SELECT subject_id, span, side, g, any_value(v) AS v, any_value(iqr) AS iqr, min(seq) AS a, max(seq) AS b FROM cg GROUP BY 1, 2, 3, 4),
    cp AS (SELECT subject_id, span, side, v, iqr, (a + b) // 2 AS p FROM ct WINDOW w AS (PARTITION BY subject_id, span, side ORDER BY g) QUALIFY v > lag(v) OVER w AND v > lead(v) OVER w),
    kd AS (SELECT c.* FROM cp c WHERE NOT EXISTS (SELECT 1 FROM cp d WHERE d.subject_id = c.subject_id AND d.span = c.span AND d.side = c.side AND d.p <> c.p AND abs(d.p - c.p) < 12 AND d.v > c.v)),
    le AS (SELECT kd.subject_id, kd.span, kd.side, kd.p, max(m.seq) FILTER (WHERE m.seq < kd.p AND m.v > kd.v) AS l, min(m.seq) FILTER (WHERE m.seq > kd.p AND m.v > kd.v) AS r FROM kd JOIN mw m ON m.subject_id = kd.subject_id AND m.span = kd.span AND m.side = kd.side GROUP BY 1, 2, 3, 4),
    pb AS (SELECT kd.subject_id, kd.span, kd.side, kd.p, any_value(kd.v) - greatest(min(m.v) FILTER (WHERE m.seq <= kd.p AND m.seq > coalesce(le.l, -1)), min(m.v) FILTER (WHERE m.seq >= kd.p AND m.seq < coalesce(le.r, 1e12))) AS up, any_value(kd.iqr) AS iqr
        FROM kd JOIN le ON le.subject_id = kd.subject_id AND le.span = kd.span AND le.side = kd.side AND le.p = kd.p JOIN mw m ON m.subject_id = kd.subject_id AND m.span = kd.span AND m.side = kd.side GROUP BY 1, 2, 3, 4),
    pk AS (SELECT * FROM pb WHERE up / 5 >= 0.1 * iqr), ns AS (SELECT subject_id, span, CASE WHEN count(*) FILTER (WHERE side = 1) >= count(*) FILTER (WHERE side = -1) THEN 1 ELSE -1 END AS side FROM pk GROUP BY 1, 2)"""


@query(f"WITH {SQL_BREATHS} SELECT pk.subject_id, pk.span::BIGINT AS span, p / 8.0::DOUBLE AS t_peak FROM pk JOIN ns ON ns.subject_id = pk.subject_id AND ns.span = pk.span AND ns.side = pk.side")
def breath_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.breath_peaks(breathing(spark, sf_dir), KEYS, RULES).select("subject_id", "span", "t_peak")


def three_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three beats for each breath, their intervals from its event's value."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), "value", (F.row_number().over(order) - 1).cast("bigint").alias("k"), (24 + 8 * (F.col("user_id") % 4)).alias("p"))
    rows = events.withColumn("m", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    return rows.select("subject_id", (3 * F.col("k") + F.col("m")).alias("seq"), ((3 * F.col("k") + F.col("m")) * F.col("p") / 24).alias("t_s"), (500 + 5 * F.col("value") + 20 * F.col("m")).alias("rr_ms"))


SQL_RSA = f"""WITH {SQL_BREATHS}, pt AS (SELECT pk.subject_id, pk.span, p / 8.0::DOUBLE AS t0 FROM pk JOIN ns ON ns.subject_id = pk.subject_id AND ns.span = pk.span AND ns.side = pk.side),
    gp AS (SELECT *, t1 - t0 BETWEEN 2 AND 10 AS ok FROM (SELECT *, lead(t0) OVER (PARTITION BY subject_id, span ORDER BY t0) AS t1 FROM pt) WHERE t1 IS NOT NULL),
    il AS (SELECT *, row_number() OVER (PARTITION BY subject_id, span ORDER BY t0) - row_number() OVER (PARTITION BY subject_id, span, ok ORDER BY t0) AS g FROM gp),
    ln AS (SELECT subject_id, span, g, count(*) AS n, min(t0) AS a FROM il WHERE ok GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY subject_id, span ORDER BY count(*) DESC, min(t0)) = 1),
    bre AS (SELECT il.subject_id, il.span, t0, t1 FROM il JOIN ln ON ln.subject_id = il.subject_id AND ln.span = il.span AND ln.g = il.g WHERE ok),
    bt AS (SELECT subject_id, (3 * k + m) * p / 24.0::DOUBLE AS t, 500 + 5 * value + 20 * m AS rr FROM (SELECT *, unnest([0, 1, 2]) AS m FROM ev)),
    ea AS (SELECT bre.subject_id, span, t0, max(rr) - min(rr) AS r FROM bre JOIN bt ON bt.subject_id = bre.subject_id AND t >= t0 AND t < t1 GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    ra AS (SELECT subject_id, avg(r) AS rsa_ms, count(*) AS nb FROM ea GROUP BY 1 HAVING count(*) >= 2),
    rt AS (SELECT subject_id, 60 / median(t1 - t0) AS rate FROM bre GROUP BY 1),
    dp AS (SELECT bre.subject_id, span, t0, max(value) - min(value) AS d FROM bre JOIN resp ON resp.subject_id = bre.subject_id AND time_s >= t0 AND time_s < t1 GROUP BY 1, 2, 3),
    da AS (SELECT subject_id, avg(d) AS amp FROM dp GROUP BY 1)"""


@query(f"{SQL_RSA} SELECT rt.subject_id, round(rsa_ms, 6) AS rsa_ms, round(ln(rsa_ms), 6) AS rsa_log_ms, round(rate, 6) AS resp_rate_bpm, nb::DOUBLE AS n_breaths_used, round(amp, 6) AS resp_amp, round(ln(amp), 6) AS resp_log_amp FROM rt LEFT JOIN ra ON ra.subject_id = rt.subject_id LEFT JOIN da ON da.subject_id = rt.subject_id")
def breath_rsa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the wave to sinus arrhythmia: peaks, breaths, the beats and the depth of each."""
    resp = breathing(spark, sf_dir)
    found = R.sinus_arrhythmia(R.breaths(R.breath_peaks(resp, KEYS, RULES), KEYS), three_beats(spark, sf_dir), resp, KEYS)
    found = rounded(found, "rsa_ms", "rsa_log_ms", "resp_rate_bpm", "resp_amp", "resp_log_amp").withColumn("n_breaths_used", F.col("n_breaths_used").cast("double"))
    return found.select("subject_id", "rsa_ms", "rsa_log_ms", "resp_rate_bpm", "n_breaths_used", "resp_amp", "resp_log_amp")


#: Medians of fifths of a second, of five of them, their means; peaks at least nine apart, as prominent as 15 % of the recording's range.
SQL_RATES = f"""WITH {SQL_BREATHING}, th AS (SELECT subject_id, CAST(floor(time_s * 5) AS BIGINT) AS q, median(value) AS v FROM resp WHERE value IS NOT NULL GROUP BY 1, 2),
    m5 AS (SELECT subject_id, q, row_number() OVER w AS r, quantile_cont(v, 0.5) OVER (PARTITION BY subject_id ORDER BY q ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM th WINDOW w AS (PARTITION BY subject_id ORDER BY q)),
    a5 AS (SELECT subject_id, q, r, avg(v) OVER (PARTITION BY subject_id ORDER BY q ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM m5),
    rn AS (SELECT subject_id, greatest(1e-6, 0.15 * (quantile_cont(v, 0.99) - quantile_cont(v, 0.01))) AS least FROM a5 GROUP BY 1),
    cg AS (SELECT *, sum(CASE WHEN v IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(v) OVER (PARTITION BY subject_id ORDER BY r) AS pv FROM a5)),
    ct AS (SELECT subject_id, g, any_value(v) AS v, min(r) AS a, max(r) AS b FROM cg GROUP BY 1, 2),
    cp AS (SELECT subject_id, v, (a + b) // 2 AS p FROM ct WINDOW w AS (PARTITION BY subject_id ORDER BY g) QUALIFY v > lag(v) OVER w AND v > lead(v) OVER w),
    kd AS (SELECT c.* FROM cp c WHERE NOT EXISTS (SELECT 1 FROM cp d WHERE d.subject_id = c.subject_id AND d.p <> c.p AND abs(d.p - c.p) < 9 AND (d.v > c.v OR (d.v = c.v AND d.p > c.p)))),
    le AS (SELECT kd.subject_id, kd.p, any_value(kd.v) AS v, max(m.r) FILTER (WHERE m.r < kd.p AND m.v > kd.v) AS l, min(m.r) FILTER (WHERE m.r > kd.p AND m.v > kd.v) AS h FROM kd JOIN a5 m ON m.subject_id = kd.subject_id GROUP BY 1, 2),
    pb AS (SELECT le.subject_id, le.p, any_value(le.v) - greatest(min(m.v) FILTER (WHERE m.r <= le.p AND m.r > coalesce(le.l, -1)), min(m.v) FILTER (WHERE m.r >= le.p AND m.r < coalesce(le.h, 1e12))) AS up FROM le JOIN a5 m ON m.subject_id = le.subject_id GROUP BY 1, 2),
    pk AS (SELECT pb.subject_id, q / 5.0::DOUBLE AS t FROM pb JOIN rn ON rn.subject_id = pb.subject_id AND up >= least JOIN a5 ON a5.subject_id = pb.subject_id AND a5.r = pb.p),
    ib AS (SELECT subject_id, (t + b) / 2 AS t, 60 / (t - b) AS bpm FROM (SELECT *, lag(t) OVER (PARTITION BY subject_id ORDER BY t) AS b FROM pk) WHERE b IS NOT NULL)
    SELECT subject_id, round(t, 6) AS t, round(quantile_cont(bpm, 0.5) OVER (PARTITION BY subject_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS bpm FROM ib"""


@query(SQL_RATES)
def breath_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.rate_series(breathing(spark, sf_dir)), "t", "bpm").select("subject_id", "t", "bpm")


@query(SQL_RATES)
def breath_rates_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 600 thinned samples that see a hundred of their neighbours."""
    found = R.rate_series(breathing(spark, sf_dir), pieces=Pieces(rows=600, seconds=60.0), reach=100)
    return rounded(found, "t", "bpm").select("subject_id", "t", "bpm")
