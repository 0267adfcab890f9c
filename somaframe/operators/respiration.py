"""Respiration: splitting and cleaning windows, breaths, and respiratory sinus arrhythmia.

What is sequential (filtering, peak picking) runs in one grouped function per (subject, window), whose rows go
on as relations. A group is one window of one subject; longer recordings are cut into windows before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from somaframe.config import BreathRules
from somaframe.functions import kernels as K
from somaframe.functions.folders import checkpoint, stored
from somaframe.functions.frames import islands, median, spread
from somaframe.functions.pieces import Pieces, same
from somaframe.functions.selection import percentiles
from somaframe.functions.shipping import ship
from somaframe.functions.sweep import inside
from somaframe.operators.time_domain import KEY

RULES = BreathRules()


def _order(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("seq")


def split(resp: DataFrame, keys: Sequence[str] = KEY, rules: BreathRules = RULES) -> DataFrame:
    """resp with `span`: a new one after each break in time (a step back, or over gap_factor median steps) or hole.
    Samples at a break have none."""
    order = _order(keys)
    step = F.col("time_s") - F.lag("time_s").over(order)
    rows = spread(resp, *keys).withColumn("_d", step)
    typical = rows.where("_d > 0").groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(median("_d").alias("_dt"))
    rows = rows.join(typical, [F.col(k) == F.col(f"_{k}") for k in keys], "left").drop(*(f"_{k}" for k in keys))
    broken = F.col("value").isNull() | F.isnan("value") | F.coalesce((F.col("_d") <= 0) | (F.col("_d") > rules.gap_factor * F.col("_dt")), F.lit(False))
    return islands(rows.withColumn("_b", broken), ~F.col("_b"), order, "span").drop("_d", "_dt", "_b")


def _spans(t: np.ndarray, value: np.ndarray, rules: BreathRules) -> np.ndarray:
    """split() of one window's samples in order, as an array; NaN where there is no span."""
    step = np.diff(t, prepend=np.nan)
    forward = np.sort(step[step > 0])
    typical = _quantile(forward, 0.5) if len(forward) else np.inf
    broken = np.isnan(value) | ~((step > 0) & (step <= rules.gap_factor * typical))
    broken[:1] = np.isnan(value[:1]) | np.isnan(t[:1])
    begin = ~broken
    begin[1:] &= broken[:-1]
    return np.where(broken, np.nan, np.cumsum(begin))


def _rolling(best: np.ufunc, v: np.ndarray, before: int, after: int, beyond: float) -> np.ndarray:
    """The best of each sample's frame, by frames of doubling length."""
    size, n, width = before + after + 1, len(v), 1
    x = np.full(n + size - 1, beyond)
    x[before : before + n] = v
    while 2 * width <= size:
        x, width = best(x[:-width], x[width:]), 2 * width
    return best(x[:n], x[size - width : size - width + n])


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (behind the last) of the runs on which the flag holds."""
    padded = np.zeros(len(flag) + 2, bool)
    padded[1:-1] = flag
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return edges[::2], edges[1::2]


def _stretches(span: np.ndarray, value: np.ndarray, rate: float, rules: BreathRules) -> np.ndarray:
    """Numbers (from 1) of the stretches of a window that neither break nor collapse; 0 elsewhere.

    Inside a span, samples whose rolling range is small for collapse_least seconds go, and so do rests of under
    five samples. (Frames of seconds hold hundreds of rows here, so they are slid over arrays.)"""
    size = max(1, round(rules.collapse_seconds * rate))
    before, after = size // 2, (size - 1) // 2
    flat, there = np.zeros(len(span), bool), ~np.isnan(span)
    for a, b in zip(*(edge.tolist() for edge in _runs(there)), strict=True):
        v, k = value[a:b], np.arange(b - a)
        width = _rolling(np.maximum, v, before, after, -np.inf) - _rolling(np.minimum, v, before, after, np.inf)
        held = np.minimum(k + after, b - a - 1) - np.maximum(k - before, 0) + 1
        flat[a:b] = (held >= max(1, size // 4)) & (width <= rules.collapse_range)
    alive = _long_runs(there & ~_long_runs(flat, round(rules.collapse_least * rate)), 5)
    begin = alive.copy()
    begin[1:] &= ~alive[:-1]
    return np.where(alive, np.cumsum(begin), 0)


def _long_runs(flag: np.ndarray, least: int) -> np.ndarray:
    """flag without its runs of under `least`."""
    out = np.zeros(len(flag), bool)
    for a, b in zip(*(edge.tolist() for edge in _runs(flag)), strict=True):
        out[a:b] = b - a >= least
    return out


def trimmed(resp: DataFrame, keys: Sequence[str] = KEY, rules: BreathRules = RULES, rate: float | None = None) -> DataFrame:
    """keys, seq, time_s, value, span, and `alive`: whether the sample is in a stretch that has not collapsed."""
    rows = split(resp, keys, rules).select(*keys, "seq", "time_s", "value", "span")
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes), "alive boolean"])
    rate = rate or rules.rate

    def run(window: pd.DataFrame) -> pd.DataFrame:
        window = window.sort_values("seq").reset_index(drop=True)
        return window.assign(alive=_stretches(window["span"].to_numpy(float), window["value"].to_numpy(float), rate, rules) > 0)

    return rows.groupBy(*keys).applyInPandas(run, schema)


def _quantile(ordered: np.ndarray, share: float) -> float:
    """Of values in order, between the two nearest (what np.percentile and np.median give, whose set-up costs more than the sort)."""
    place = share * (len(ordered) - 1)
    k = int(place)
    low, high, part = float(ordered[k]), float(ordered[min(k + 1, len(ordered) - 1)]), place - k
    return low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)


def _width(v: np.ndarray) -> float:
    """Of the middle 90 %."""
    ordered = np.sort(v)
    return _quantile(ordered, 0.95) - _quantile(ordered, 0.05)


def _median(v: np.ndarray) -> float:
    return _quantile(np.sort(v), 0.5)


def _variation(v: np.ndarray, mid: float) -> float:
    """The standard deviation over mid. Differences from mid are summed before anything is divided, so that values of few binary digits
    give the nearest double; the mean of ten periods has errors of its own, and a share of 0.00625 would be rounded down."""
    apart = v - mid
    return math.sqrt(max(0.0, float(len(v) * (apart @ apart) - apart.sum() ** 2))) / (len(v) * mid)


def _gate(t: np.ndarray, v: np.ndarray, rules: BreathRules) -> tuple[str, dict[str, float]]:
    """ok, or the first test that a stretch fails, and what was measured on the way."""
    found: dict[str, float] = {}
    seconds = t[-1] - t[0] if len(t) else 0.0
    if seconds < rules.least_seconds:
        return "too_short", found
    if _width(v) < rules.least_raw:
        return "raw_flat", found
    rate = 1 / _median(np.diff(t))
    try:
        y = K.zero_phase(*K.band_pass(3, *rules.band, rate), v - _median(v))
    except ValueError:
        return "bandpass_failed", found
    if _width(y) < rules.least_filtered:
        return "filtered_flat", found
    hz, power = K.spectrum(y, rate, max(8, int(rules.segment_seconds * rate)))
    band = (hz >= rules.band[0]) & (hz <= rules.band[1])
    if not band.any() or not np.isfinite(power[band]).all() or power[band].max() <= 0:
        return "psd_invalid", found
    p = power[band]
    found |= {"peak_hz": float(hz[band][p.argmax()]), "ratio": float(p.max() / p.mean()), "prominence": float((p.max() - _median(p)) / max(_median(p), 1e-12))}
    gap = int(np.clip(0.5 / found["peak_hz"], 1, 4) * rate)
    best = max((K.peaks(y, gap), K.peaks(-y, gap)), key=len)
    periods = np.diff(t[best])
    if len(periods) >= 10:
        ordered = np.sort(periods)
        lo, hi = _quantile(ordered, 0.1), _quantile(ordered, 0.9)
        some = periods[(periods >= lo) & (periods <= hi)]
        periods = some if len(some) >= 3 else periods
    found["cycles"] = float(max(0, len(best) - 1))
    if found["cycles"] < rules.least_cycles or not len(periods):
        return "too_few_cycles", found
    mid = _median(periods)
    found["cv"] = float(max(_variation(periods, mid), 1.4826 * _median(np.abs(periods - mid)) / mid))
    found["bpm"] = 60 / mid
    if not rules.band[0] <= found["peak_hz"] <= rules.band[1]:
        return "psd_peak_out_of_band", found
    if found["ratio"] < rules.least_ratio:
        return "psd_ratio", found
    apart = abs(found["bpm"] - 60 * found["peak_hz"])
    soft = found["cycles"] >= rules.soft_cycles and found["cv"] <= rules.soft_variation and apart <= rules.most_disagreement
    if found["prominence"] < rules.least_prominence and not soft:
        return "psd_prominence", found
    if not 60 * rules.band[0] <= found["bpm"] <= 60 * rules.band[1]:
        return "bpm_out_of_band", found
    if found["cv"] > rules.most_variation:
        return "irregular", found
    if apart > rules.most_disagreement:
        return "disagreement", found
    return "ok", found


def canonical_plateaus(t: np.ndarray, v: np.ndarray, rules: BreathRules = RULES) -> np.ndarray:
    """Flat tops near peaks get one top sample: the longest run within plateau_tolerance of the local maximum is
    lowered by one (not below zero) but for its centre."""
    out = v.copy()
    rate = 1 / _median(np.diff(t)) if len(t) > 1 else 1.0
    tops = K.peaks(v, max(1, int(rate)))
    firsts = np.maximum(np.searchsorted(t, t[tops] - rules.plateau_reach) - 1, 0)
    ends = np.minimum(np.searchsorted(t, t[tops] + rules.plateau_reach, "right") + 1, len(t))
    times, values = t.tolist(), v.tolist()
    for p, a, b in zip(tops.tolist(), firsts.tolist(), ends.tolist(), strict=True):
        while abs(times[a] - times[p]) > rules.plateau_reach:
            a += 1
        while abs(times[b - 1] - times[p]) > rules.plateau_reach:
            b -= 1
        least = max(values[a:b]) - rules.plateau_tolerance
        best, start = (a, a), None
        for i in range(a, b + 1):
            if i < b and values[i] >= least:
                start = i if start is None else start
            elif start is not None:
                best, start = (start, i) if i - start > best[1] - best[0] else best, None
        first, end = best
        if times[end - 1] - times[first] >= rules.plateau_seconds:
            rest = np.delete(np.arange(first, end), (end - first) // 2)
            out[rest] = np.maximum(0, out[rest] - 1)
    return out


@dataclass(frozen=True)
class _Samples:
    """A window's samples in order, as arrays (a table's own work on each of its parts costs more than the filters do)."""

    keys: dict[str, object]
    seq: np.ndarray
    t: np.ndarray
    v: np.ndarray
    stretch: np.ndarray

    def stretches(self) -> list[tuple[int, slice]]:
        """Numbers and places of the stretches; each is a run of samples."""
        numbers, starts, ends = self.stretch, *_runs(self.stretch > 0)
        return [(int(numbers[a]), slice(a, b)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def table(self, n: int, **columns: object) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] * n for k, v in self.keys.items()}, **columns})


def _windows(resp: DataFrame, keys: Sequence[str], rules: BreathRules, rate: float | None) -> tuple[DataFrame, dict[str, str], Callable[[pd.DataFrame | pa.Table], _Samples]]:
    """The samples, the types of their columns, and what orders a window's samples and numbers its stretches. They are not dealt anew where they
    are dealt by the keys already."""
    ship(resp.sparkSession)
    rows = resp.select(*keys, "seq", "time_s", "value")

    def numbered(window: pd.DataFrame | pa.Table) -> _Samples:
        seq, t, value = (window[c].to_numpy() for c in ("seq", "time_s", "value"))
        order = np.argsort(seq, kind="stable")
        t, value = t[order].astype(float), value[order].astype(float)
        stretch = _stretches(_spans(t, value, rules), value, rate or rules.rate, rules)
        first = {k: window[k][0] for k in keys}
        return _Samples({k: v.as_py() if isinstance(v, pa.Scalar) else v for k, v in first.items()}, seq[order], t, value, stretch)

    return rows, {f.name: f.dataType.simpleString() for f in rows.schema.fields}, numbered


def filtered(resp: DataFrame, keys: Sequence[str] = KEY, rules: BreathRules = RULES, rate: float | None = None) -> DataFrame:
    """keys, seq, time_s, stretch, y: stretches that are long and deep enough, less their median and band-passed without shift."""
    rows, kinds, numbered = _windows(resp, keys, rules, rate)

    def run(window: pd.DataFrame) -> pd.DataFrame:
        own = numbered(window)
        y = np.full(len(own.t), np.nan)
        for _, at in own.stretches():
            t, v = own.t[at], own.v[at]
            if t[-1] - t[0] >= rules.least_seconds and _width(v) >= rules.least_raw:
                y[at] = K.zero_phase(*K.band_pass(3, *rules.band, 1 / _median(np.diff(t))), v - _median(v))
        there = np.flatnonzero(~np.isnan(y))
        return own.table(len(there), seq=own.seq[there], time_s=own.t[there], stretch=own.stretch[there], y=y[there])

    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, "seq")), "time_s double, stretch long, y double"]))


FIGURES = ("peak_hz", "ratio", "prominence", "cv", "cycles", "bpm")


def judged(resp: DataFrame, keys: Sequence[str] = KEY, rules: BreathRules = RULES, rate: float | None = None) -> DataFrame:
    """keys, stretch, verdict (ok, or the first test that it fails), and the figures measured up to that test."""
    rows, kinds, numbered = _windows(resp, keys, rules, rate)

    def run(window: pd.DataFrame) -> pd.DataFrame:
        own, found = numbered(window), []
        for number, at in own.stretches():
            verdict, figures = _gate(own.t[at], own.v[at], rules)
            found.append({**own.keys, "stretch": number, "verdict": verdict, **{f: figures.get(f) for f in FIGURES}})
        out = pd.DataFrame(found, columns=[*keys, "stretch", "verdict", *FIGURES])
        return out.astype(dict.fromkeys(FIGURES, float))

    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "stretch long, verdict string", *(f"{f} double" for f in FIGURES)]))


REPORT = "status string, reason string, peak_hz double, ratio double, prominence double, cv double, cycles double, bpm double"


def _kept(own: _Samples, rules: BreathRules, policy: str) -> tuple[list[slice], dict[str, object]]:
    """The stretches of a window that are kept, and its status, reason and figures."""
    kept, tried = [], []
    for _, at in own.stretches():
        reason, found = _gate(own.t[at], own.v[at], rules)
        if reason == "ok":
            kept.append(at)
            tried.append(found)
    seconds = [own.t[at.stop - 1] - own.t[at.start] for at in kept]
    if policy == "longest" and kept:
        best = int(np.argmax(seconds))
        kept, tried, seconds = [kept[best]], [tried[best]], [seconds[best]]
    figures = {name: _median(np.array([f[name] for f in tried])) if tried else None for name in FIGURES}
    if not kept:
        return [], {"status": "reject", "reason": "no_physio_rhythm", **figures}
    if sum(seconds) < rules.least_seconds:
        return [], {"status": "reject", "reason": "no_valid_span", **figures}
    if sum(at.stop - at.start for at in kept) >= rules.kept_share * len(own.t):
        return kept, {"status": "ok", "reason": None, **figures}
    return kept, {"status": "partial", "reason": "trimmed", **figures}


POLICIES = ("multi", "longest")


def cleaned(resp: DataFrame, keys: Sequence[str] = KEY, rules: BreathRules = RULES, rate: float | None = None, policy: str = "multi") -> DataFrame:
    """keys, seq, time_s, value (null outside kept stretches), stretch, and the window's report in every row.

    Stretches that pass the gate are kept: all, or the longest. A window without any, or with too little kept,
    is rejected and all null; from kept_share on it is ok, below partial."""
    if policy not in POLICIES:
        raise ValueError("policy is multi or longest")
    rows, kinds, numbered = _windows(resp, keys, rules, rate)

    def run(window: pa.Table) -> pa.Table:
        own = numbered(window)
        kept, found = _kept(own, rules, policy)
        n, value = len(own.t), np.full(len(own.t), np.nan)
        for at in kept:
            value[at] = canonical_plateaus(own.t[at], own.v[at], rules)
        same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)
        columns = {k: same(own.keys[k], window.schema.field(k).type) for k in keys}
        columns |= {"seq": pa.array(own.seq, window.schema.field("seq").type), "time_s": pa.array(own.t), "value": pa.array(value, from_pandas=True), "stretch": pa.array(own.stretch, pa.int64())}
        return pa.table(columns | {name: same(v, pa.string() if name in ("status", "reason") else pa.float64()) for name, v in found.items()})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*keys, "seq")), "time_s double, value double, stretch long", REPORT])
    return rows.groupBy(*keys).applyInArrow(run, schema)


def reports(resp: DataFrame, keys: Sequence[str] = KEY, rules: BreathRules = RULES, rate: float | None = None, policy: str = "multi") -> DataFrame:
    """report() of cleaned() without the cleaned samples, of which none leaves the grouped function: one row per window."""
    if policy not in POLICIES:
        raise ValueError("policy is multi or longest")
    rows, kinds, numbered = _windows(resp, keys, rules, rate)
    spans_kind = pa.list_(pa.struct([("t0", pa.float64()), ("t1", pa.float64())]))

    def run(window: pa.Table) -> pa.Table:
        own = numbered(window)
        kept, found = _kept(own, rules, policy)
        columns = {k: pa.array([own.keys[k]], window.schema.field(k).type) for k in keys}
        columns |= {name: pa.array([v], pa.string() if name in ("status", "reason") else pa.float64()) for name, v in found.items()}
        spans = sorted((float(own.t[at.start]), float(own.t[at.stop - 1])) for at in kept)
        share = sum(at.stop - at.start for at in kept) / len(own.t)
        return pa.table(columns | {"kept_share": pa.array([share]), "kept_spans": pa.array([[{"t0": a, "t1": b} for a, b in spans]], spans_kind)})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), REPORT, "kept_share double, kept_spans array<struct<t0: double, t1: double>>"])
    return rows.groupBy(*keys).applyInArrow(run, schema)


def report(cleaned: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per window: status, figures, share kept, and the kept spans as array<struct<t0, t1>>."""
    names = ["status", "reason", *FIGURES]
    there = F.col("value").isNotNull()
    # by stretch first, so that the grouped function before runs once
    parts = cleaned.groupBy(*keys, "stretch").agg(
        *(F.first(n).alias(n) for n in names), F.min(F.when(there, F.col("time_s"))).alias("t0"), F.max(F.when(there, F.col("time_s"))).alias("t1"), F.count("value").alias("_kept"), F.count("*").alias("_n")
    )
    spans = F.sort_array(F.collect_list(F.when(F.col("_kept") > 0, F.struct("t0", "t1"))))
    return parts.groupBy(*keys).agg(*(F.first(n).alias(n) for n in names), (F.sum("_kept") / F.sum("_n")).alias("kept_share"), spans.alias("kept_spans"))


def masked(resp: DataFrame, report: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """resp with values outside a window's kept spans null."""
    # a window's report is looked up, so that samples need no order
    joined = resp.join(report.select(*keys, "kept_spans").hint("shuffle_hash"), list(keys), "left")
    inside = F.exists("kept_spans", lambda s: (F.col("time_s") >= s.t0) & (F.col("time_s") <= s.t1))
    return joined.withColumn("value", F.when(F.coalesce(inside, F.lit(False)), F.col("value"))).drop("kept_spans")


def breath_peaks(resp: DataFrame, keys: Sequence[str] = KEY, rules: BreathRules = RULES) -> DataFrame:
    """keys, span, t_peak: peaks of the smoothed stretches without holes, of whichever polarity has more cycles."""
    rows = split(resp, keys, rules).where("span IS NOT NULL").select(*keys, "span", "seq", "time_s", "value")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(window: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(window["seq"].to_numpy(), kind="stable")
        spans, times, values = (window[c].to_numpy()[order] for c in ("span", "time_s", "value"))
        borders = [0, *(np.flatnonzero(spans[1:] != spans[:-1]) + 1).tolist(), len(spans)]
        numbers, found = [], []
        for first, end in zip(borders[:-1], borders[1:], strict=True):
            t, v = times[first:end].astype(float), values[first:end].astype(float)
            if len(v) < 5:
                continue
            iqr = np.subtract(*np.percentile(v, [75, 25]))
            if iqr <= rules.least_iqr:
                continue
            dt = float(np.median(np.diff(t)))
            n = max(1, round(rules.smooth_seconds / dt)) | 1
            smooth = np.convolve(v, np.ones(n), "same") / n if n <= len(v) else v
            gap = max(1, int(60 / rules.most_bpm / dt * 0.8))
            best = max((K.peaks(s * smooth, gap, rules.prominence_share * iqr) for s in (1, -1)), key=len)
            numbers.append(np.repeat(spans[first], len(best)))
            found.append(t[best])
        at = np.concatenate(found) if found else np.zeros(0)
        return pd.DataFrame({**{k: window[k].iloc[:1].repeat(len(at)).to_numpy() for k in keys}, "span": np.concatenate(numbers) if numbers else np.zeros(0, int), "t_peak": at})

    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"span {kinds['span']}", "t_peak double"]))


def breaths(peaks: DataFrame, keys: Sequence[str] = KEY, rules: BreathRules = RULES) -> DataFrame:
    """keys, span, t0, t1 of the breaths in the longest run of physiological gaps of each span (the first of equals)."""
    order = Window.partitionBy(*keys, "span").orderBy("t_peak")
    gaps = peaks.withColumn("_next", F.lead("t_peak").over(order)).where("_next IS NOT NULL").withColumn("seq", F.col("t_peak"))
    length = F.col("_next") - F.col("t_peak")
    runs = islands(gaps, length.between(60 / rules.most_bpm, 60 / rules.least_bpm), order, "_run").where("_run IS NOT NULL")
    sized = runs.groupBy(*keys, "span", "_run").agg(F.count("*").alias("_n"))
    best = sized.groupBy(*keys, "span").agg(F.max_by("_run", F.struct("_n", -F.col("_run"))).alias("_run"))
    return runs.join(best, [*keys, "span", "_run"]).select(*keys, "span", F.col("t_peak").alias("t0"), F.col("_next").alias("t1"))


def _ranges(breaths: DataFrame, points: DataFrame, time: str, value: str, keys: Sequence[str], seconds: float | None) -> DataFrame:
    """keys, span, t0, _range (highest less lowest value in the breath) and _n, of the breaths that hold any point."""
    found = inside(breaths.select(*keys, "span", "t0", "t1"), points.select(*keys, F.col(time).alias("_t"), F.col(value).alias("_v")), "_t", keys, seconds)
    return found.groupBy(*keys, "span", "t0").agg((F.max("_v") - F.min("_v")).alias("_range"), F.count("*").alias("_n"))


def sinus_arrhythmia(breaths: DataFrame, beats: DataFrame, resp: DataFrame | None = None, keys: Sequence[str] = KEY, rules: BreathRules = RULES, seconds: float | None = None) -> DataFrame:
    """keys, rsa_ms (mean over breaths of the range of beats in one), rsa_log_ms, resp_rate_bpm, n_breaths_used, and with
    resp its amplitude. Breaths need least_beats beats, windows least_breaths breaths. Times of both share an origin.
    seconds: the width of the cells that a long window is cut into (functions/sweep.py)."""
    each = _ranges(breaths, beats, "t_s", "rr_ms", keys, seconds).where(F.col("_n") >= rules.least_beats)
    rsa = each.groupBy(*keys).agg(F.avg("_range").alias("rsa_ms"), F.count("*").alias("n_breaths_used")).where(F.col("n_breaths_used") >= rules.least_breaths)
    rate = breaths.groupBy(*keys).agg((60 / median(F.col("t1") - F.col("t0"))).alias("resp_rate_bpm"))
    out = rate.join(rsa, list(keys), "left").withColumn("rsa_log_ms", F.when(F.col("rsa_ms") > 0, F.ln("rsa_ms")))
    if resp is not None:
        depth = _ranges(breaths, resp, "time_s", "value", keys, seconds).groupBy(*keys).agg(F.avg("_range").alias("resp_amp"))
        out = out.join(depth, list(keys), "left").withColumn("resp_log_amp", F.when(F.col("resp_amp") > 0, F.ln("resp_amp")))
    return out


def window_arrhythmia(breaths: DataFrame, beats: DataFrame, resp: DataFrame | None = None, keys: Sequence[str] = KEY, rules: BreathRules = RULES, seconds: float | None = None) -> DataFrame:
    """keys, rsa_ms, rsa_log_ms, resp_amp, resp_log_amp, resp_rate_bpm, n_breaths_used, rsa_method: spans rolled up to windows.

    A span needs least_breaths breaths with least_beats beats each. The window has the mean of its spans' means of ranges (and
    of depths), and the median of their rates; without such a span it is unavailable."""
    each = _ranges(breaths, beats, "t_s", "rr_ms", keys, seconds).where(F.col("_n") >= rules.least_beats)
    spans = each.groupBy(*keys, "span").agg(F.avg("_range").alias("_rsa"), F.count("*").alias("_k")).where(F.col("_k") >= rules.least_breaths)
    spans = spans.join(breaths.groupBy(*keys, "span").agg((60 / median(F.col("t1") - F.col("t0"))).alias("_rate")), [*keys, "span"])
    if resp is None:
        spans = spans.withColumn("_amp", F.lit(None).cast("double"))
    else:
        depth = _ranges(breaths, resp, "time_s", "value", keys, seconds)
        spans = spans.join(depth.groupBy(*keys, "span").agg(F.avg("_range").alias("_amp")), [*keys, "span"], "left")
    rolled = spans.groupBy(*keys).agg(F.avg("_rsa").alias("rsa_ms"), F.avg("_amp").alias("resp_amp"), median("_rate").alias("resp_rate_bpm"), F.sum("_k").alias("_used"))
    found = breaths.select(*keys).distinct().join(rolled, list(keys), "left")
    log = lambda c: F.when(F.col(c) > 0, F.ln(c)).alias(c.replace("_ms", "").replace("_amp", "") + ("_log_ms" if c.endswith("_ms") else "_log_amp"))
    return found.select(*keys, "rsa_ms", log("rsa_ms"), "resp_amp", log("resp_amp"), "resp_rate_bpm", F.coalesce("_used", F.lit(0)).cast("long").alias("n_breaths_used"), F.when(F.col("rsa_ms").isNull(), "unavailable").otherwise("peak_to_valley").alias("rsa_method"))


def longest_run(rows: DataFrame, flag: Column, keys: Sequence[str], name: str) -> DataFrame:
    """keys and the length of the longest run of rows (in order of seq) on which the flag holds; 0 if none."""
    own = islands(rows.select(*keys, "seq", flag.alias("_f")), F.col("_f"), _order(keys), "_run")
    runs = own.groupBy(*keys, "_run").agg(F.count("_run").alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias(name))


def signal_report(resp: DataFrame, keys: Sequence[str] = KEY, low: float = 0.0, high: float = 1023.0, edge: float = 1.0, rules: BreathRules = RULES) -> DataFrame:
    """One row for each window with figures of the signal as it came: rows and holes, the typical step and how far steps are
    from it, the share of gaps, the range of the middle 90 %, and the share and longest run at the converter's edges and without change."""
    order = _order(keys)
    rows = resp.withColumns({"_d": F.col("time_s") - F.lag("time_s").over(order), "_x": F.col("value") - F.lag("value").over(order)})
    rows = rows.withColumn("_next", F.lead("_x").over(order))
    typical = rows.groupBy(*keys).agg(median(F.when(F.col("_d") > 0, F.col("_d"))).alias("time_median_dt"))
    rows = rows.join(typical, list(keys))
    clip = F.coalesce((F.col("value") <= low + edge) | (F.col("value") >= high - edge), F.lit(False))
    flat = F.coalesce(F.abs("_x") <= rules.plateau_tolerance, F.lit(False)) | F.coalesce(F.abs("_next") <= rules.plateau_tolerance, F.lit(False))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    figures = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_holes"), F.first("time_median_dt").alias("time_median_dt"), (F.max("time_s") - F.min("time_s")).alias("duration_s"),
        F.avg(F.when(F.col("_d").isNotNull(), F.when((F.col("_d") <= 0) | (F.col("_d") > rules.gap_factor * F.col("time_median_dt")), 1.0).otherwise(0.0))).alias("time_gap_frac"),
        median(F.abs(F.col("_d") - F.col("time_median_dt"))).alias("time_median_dt_dev"),
        (F.percentile("value", F.lit(0.95)) - F.percentile("value", F.lit(0.05))).alias("ptp_raw_p95p5"), share(clip).alias("clip_frac_all"), share(flat).alias("flat_frac_all"),
    )
    return figures.join(longest_run(rows, clip, keys, "clip_max_run_all"), list(keys)).join(longest_run(rows, flat, keys, "flat_max_run_all"), list(keys))


def full_report(resp: DataFrame, cleaned: DataFrame | None = None, expected: DataFrame | None = None, keys: Sequence[str] = KEY, rules: BreathRules = RULES) -> DataFrame:
    """report() with the figures of signal_report(), what was kept in seconds and cycles, the dropped spans between the kept ones, and
    the expected duration (expected: keys, expected_duration_s). cleaned: if it is there already; else only reports() are made."""
    out = (reports(resp, keys, rules) if cleaned is None else report(cleaned, keys)).join(signal_report(resp, keys, rules=rules), list(keys))
    if expected is not None:
        out = out.join(expected.select(*keys, "expected_duration_s"), list(keys), "left")
    else:
        out = out.withColumn("expected_duration_s", F.lit(None).cast("double"))
    ends = resp.groupBy(*keys).agg(F.min("time_s").alias("_t0"), F.max("time_s").alias("_t1"))
    kept = F.col("kept_spans")
    begins = F.concat(F.array("_t0"), F.transform(kept, lambda s: s.t1))
    stops = F.concat(F.transform(kept, lambda s: s.t0), F.array("_t1"))
    dropped = F.filter(F.zip_with(begins, stops, lambda a, b: F.struct(a.alias("t0"), b.alias("t1"))), lambda s: s.t1 - s.t0 > rules.gap_factor * F.col("time_median_dt"))
    seconds = F.aggregate(kept, F.lit(0.0), lambda acc, s: acc + s.t1 - s.t0)
    return out.join(ends, list(keys)).withColumns({"dropped_spans": dropped, "kept_dur_s": seconds, "kept_cycles": F.when(F.col("status") == "reject", 0).otherwise(F.coalesce("cycles", F.lit(0.0))).cast("long")}).drop("_t0", "_t1")


#: Pieces of a thinned recording (an hour at 5 Hz), and what each sees of its neighbours (a minute).
RATE_PIECES, RATE_REACH = Pieces(rows=18_000, seconds=3_600.0), 300


#: Rows of a recording whose range one grouped function tells; that of longer ones is counted by percentiles().
RANGE_ROWS = 1_000_000
#: A row of a series holds many values (v) of a recording, in their order: their places are consecutive but where (_o, from 0) a run begins, at place _s.
SERIES = "_o array<int>, _s array<long>, v array<double>"


def _coded(seq: np.ndarray, v: np.ndarray) -> dict[str, pa.Array]:
    """One row of a series."""
    begin = np.flatnonzero(np.append(True, np.diff(seq) != 1))
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    return {"_o": one(begin.astype(np.int32), pa.int32()), "_s": one(seq[begin].astype(np.int64), pa.int64()), "v": one(v, pa.float64())}


def _whole(parts: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """The rank of the first value, places and values of all rows of a piece, as dealt() gives them."""
    ranks, seq, values = parts["_rank"].to_numpy(), [], []
    for i in np.argsort(ranks).tolist():
        o, s, v = (parts[c][i].values.to_numpy(zero_copy_only=False) for c in ("_o", "_s", "v"))
        at = parts["_from"][i].as_py() + np.arange(len(v))
        run = np.searchsorted(o, at, "right") - 1
        seq.append(s[run] + at - o[run])
        values.append(v)
    return int(ranks.min()), np.concatenate(seq), np.concatenate(values)


def _dealt(series: DataFrame, keys: Sequence[str], pieces: Pieces, reach: int) -> DataFrame:
    """keys, _at (a piece), and of the rows of a series (_rank: of the first value) what that piece sees: its own values and `reach` around them."""
    if not 0 <= reach <= pieces.rows:
        raise ValueError("a piece must have as many rows as it looks around")
    end = F.col("_rank") + F.size("v")
    first, last = F.floor((F.col("_rank") - reach) / pieces.rows), F.floor((end - 1 + reach) / pieces.rows)
    rows = series.withColumns({"_end": end, "_at": F.explode(F.sequence(F.greatest(first, F.lit(0).cast("bigint")), last))})
    rows = rows.withColumns({"_lo": F.greatest(F.col("_at") * pieces.rows - reach, "_rank"), "_hi": F.least((F.col("_at") + 1) * pieces.rows + reach, "_end")})
    start = F.col("_lo") - F.col("_rank")
    rows = rows.select(*keys, "_at", F.col("_lo").alias("_rank"), start.alias("_from"), "_o", "_s", F.slice("v", (start + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int")).alias("v"))
    return spread(rows, *keys, "_at")


def _smooth(v: np.ndarray, size: int) -> np.ndarray:
    """Medians of five, and their means of `size`, of fewer at the ends."""
    n, middle = len(v), np.empty(len(v))
    if n >= 5:
        middle[2:-2] = np.sort(np.lib.stride_tricks.sliding_window_view(v, 5), axis=1)[:, 2]
    for i in {*range(min(2, n)), *range(max(0, n - 2), n)} if n >= 5 else range(n):
        own = np.sort(v[max(0, i - 2) : i + 3])
        middle[i] = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
    total, count = np.zeros(n), np.zeros(n)
    for d in range(-(size // 2), (size - 1) // 2 + 1):  # in the order of rows, as avg() adds them
        a, b = max(0, -d), min(n, n - d)
        if a < b:
            total[a:b] += middle[a + d : b + d]
            count[a:b] += 1
    return total / count


def _ranges_of(series: DataFrame, keys: Sequence[str], low: float = 0.01, high: float = 0.99, most: int = RANGE_ROWS) -> DataFrame:
    """keys, _lo, _hi: these percentiles of each recording."""
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}

    def run(rows: pa.Table) -> pa.Table:
        ordered, found = np.sort(np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in rows["v"]])), {}
        for name, share in (("_lo", low), ("_hi", high)):
            place = share * (len(ordered) - 1)
            a, b = math.floor(place), math.ceil(place)
            found[name] = pa.array([float(ordered[a] if a == b else (b - place) * ordered[a] + (place - a) * ordered[b])])
        return pa.table({k: rows[k].slice(0, 1) for k in keys} | found)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_lo double, _hi double"])
    few = lambda rows: spread(rows.select(*keys, "v"), *keys).groupBy(*keys).applyInArrow(run, schema)
    long = checkpoint(series.groupBy(*keys).agg(F.sum("_n").alias("_all")).where(F.col("_all") > most).select(*keys, F.lit(True).alias("_long")))
    if long.isEmpty():
        return few(series)
    marked = same(series, long, keys)
    more = percentiles(marked.where("_long").select(*keys, F.explode("v").alias("v")), "v", (low, high), ("_lo", "_hi"), keys)
    return few(marked.where("_long IS NULL")).unionByName(more)


def _deep(peaks: DataFrame, series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, t of the peaks that are prominent on both sides. On an open side (_before, _behind) neither a value that is low enough nor a
    higher one is near; the nearest piece that holds one of them is found by the pieces' extremes, and only its rows are read."""
    sure, left = peaks.where("NOT _before AND NOT _behind").select(*keys, "t"), peaks.where("_before OR _behind")
    if left.isEmpty():
        return sure
    sides = F.filter(F.array(F.when(F.col("_before"), -1), F.when(F.col("_behind"), 1)), lambda side: side.isNotNull())
    left = left.withColumns({"_sides": F.size(sides), "_side": F.explode(sides)}).select(*(F.col(k).alias(f"_of_{k}") for k in keys), "t", "_at", "_height", "_least", "_sides", "_side")
    own, same_keys = [f"_of_{k}" for k in keys], [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    outside = (F.col("_side") * (F.col("_piece") - F.col("_at")) > 0) & ((F.col("_max") > F.col("_height")) | (F.col("_height") - F.col("_min") >= F.col("_least")))
    near = left.join(series.select(*keys, "_piece", "_min", "_max"), [*same_keys, outside]).groupBy(*own, "t", "_at", "_height", "_least", "_sides", "_side").agg(F.min(F.abs(F.col("_piece") - F.col("_at"))).alias("_far"))
    held = near.join(series.select(*keys, "_piece", "_rank", "v"), [*same_keys, F.col("_piece") == F.col("_at") + F.col("_side") * F.col("_far")])
    held = held.select(*own, "t", "_height", "_least", "_sides", "_side", "_rank", F.posexplode("v").alias("_place", "v"))
    low = F.col("_height") - F.col("v") >= F.col("_least")
    met = held.where(low | (F.col("v") > F.col("_height")))
    met = met.groupBy(*own, "t", "_sides", "_side").agg(F.max_by(low, -F.col("_side") * (F.col("_rank") + F.col("_place"))).alias("_low"))
    deep = met.where("_low").groupBy(*own, "t", "_sides").agg(F.count("*").alias("_n")).where("_n = _sides")
    return sure.unionByName(deep.select(*(F.col(f"_of_{k}").alias(k) for k in keys), "t"))


def rate_series(resp: DataFrame, keys: Sequence[str] = ("subject_id",), hz: float = 5.0, smooth: int = 5, pieces: Pieces = RATE_PIECES, reach: int = RATE_REACH) -> DataFrame:
    """keys, t, bpm: breathing rate between peaks of the thinned (medians of 1 / hz seconds), smoothed signal.

    The range that sets the least prominence is the whole recording's; smoothing and peaks are found in pieces of the
    thinned recording, with borders of `reach` rows. How far a peak stands out is judged over as much of the recording as it takes. Samples
    are thinned cell by cell where they are, and from there on a cell or piece is one row, not one for each value."""
    ship(resp.sparkSession)
    samples = resp.where("value IS NOT NULL").select(*keys, F.floor(F.col("time_s") * hz).alias("seq"), F.col("value").cast("double").alias("value"))
    samples = samples.withColumn("_cell", F.floor(F.col("seq") / hz / pieces.seconds))
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    first = lambda rows: {k: rows[k].slice(0, 1) for k in keys}

    def thinned(cell: pa.Table) -> pa.Table:
        seq, v = cell["seq"].to_numpy(), cell["value"].to_numpy()
        order = np.lexsort((v, seq))
        seq, v = seq[order], v[order]
        begin = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        n = np.diff(np.append(begin, len(seq)))
        v = (v[begin + (n - 1) // 2] + v[begin + n // 2]) / 2
        return pa.table(first(cell) | {"_cell": cell["_cell"].slice(0, 1), "_n": pa.array([len(v)])} | _coded(seq[begin], v))

    cells = stored(samples.groupBy(*keys, "_cell").applyInArrow(thinned, f"{named}, _cell long, _n long, {SERIES}"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = same(cells, cells.select(*keys, "_cell", before.alias("_rank")), [*keys, "_cell"])

    def smoothed(parts: pa.Table) -> pa.Table:
        (rank, seq, v), at = _whole(parts), parts["_at"][0].as_py()
        v = _smooth(v, smooth)
        own = slice(max(0, at * pieces.rows - rank), max(0, (at + 1) * pieces.rows - rank))
        seq, v = seq[own], v[own]
        if not len(v):  # another piece's border only
            return empty
        ordered = np.sort(v)
        found = {"_piece": pa.array([at]), "_rank": pa.array([at * pieces.rows]), "_n": pa.array([len(v)]), "_min": pa.array([ordered[0]]), "_max": pa.array([ordered[-1]])}
        return pa.table(first(parts) | found | _coded(seq, v))

    schema = f"{named}, _piece long, _rank long, _n long, _min double, _max double, {SERIES}"
    empty = to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()
    series = stored(_dealt(ranked, keys, pieces, 2 + smooth // 2).groupBy(*keys, "_at").applyInArrow(smoothed, schema))

    def run(parts: pa.Table) -> pa.Table:
        (rank, seq, v), at = _whole(parts), parts["_at"][0].as_py()
        found = K.peaks(v, int(np.ceil(hz * 2 * 0.9)))
        found = found[(found + rank >= at * pieces.rows) & (found + rank < (at + 1) * pieces.rows)]
        low, met = K.bases(v, found)
        # behind a border the recording may go on
        more = np.array([rank > 0, rank + len(v) >= (at + 1) * pieces.rows + reach])
        open_ = ~met & more
        same_key = {k: pa.repeat(parts[k][0], len(found)) for k in keys}
        return pa.table(same_key | {"t": seq[found] / hz, "_at": np.full(len(found), at), "_height": v[found], "_low0": low[:, 0], "_low1": low[:, 1], "_open0": open_[:, 0], "_open1": open_[:, 1]})

    peaks = _dealt(series, keys, pieces, reach).groupBy(*keys, "_at").applyInArrow(run, f"{named}, t double, _at long, _height double, _low0 double, _low1 double, _open0 boolean, _open1 boolean")
    least = F.greatest(F.lit(1e-6), F.nanvl(0.15 * (F.col("_hi") - F.col("_lo")), F.lit(1e-6)))
    peaks = same(peaks, _ranges_of(series, keys), keys).withColumn("_least", least)
    # what is too low here, with nothing higher up to a border behind which the recording may go on, is looked for there
    deep = [F.col("_height") - F.col(f"_low{i}") >= F.col("_least") for i in (0, 1)]
    peaks = peaks.where((deep[0] | F.col("_open0")) & (deep[1] | F.col("_open1"))).withColumns({"_before": ~deep[0], "_behind": ~deep[1]})
    peaks = _deep(stored(peaks.select(*keys, "t", "_at", "_height", "_least", "_before", "_behind")), series, keys)
    order = Window.partitionBy(*keys).orderBy("t")
    found = peaks.withColumn("_before", F.lag("t").over(order)).where("_before IS NOT NULL").select(*keys, ((F.col("t") + F.col("_before")) / 2).alias("t"), (60 / (F.col("t") - F.col("_before"))).alias("bpm"))
    return found.withColumn("bpm", median("bpm").over(order.rowsBetween(-1, 1)))
