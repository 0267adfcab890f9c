"""Parameters of the engine: tables of names and thresholds, all with defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Which words in a file name mean which signal; the first match in this order counts.
SIGNAL_WORDS: dict[str, list[str]] = {
    "ecg": ["ecg"],
    "rr": ["rr", "ibi", "ppi"],
    "hr": ["hr", "bpm", "heart_rate"],
    "resp": ["resp", "respiration", "breath", "breathing"],
    "ppg": ["ppg", "bvp"],
    "acc": ["acc", "accelerometer", "accel"],
    "events": ["markers", "events"],
}

# Suffixes that vendors' device names give to heart-rate and acceleration files.
DEVICE_SUFFIXES = {"h10": "h", "verity": "v"}

# Spellings of a missing value in tables.
MISSING_WORDS = ("", "NA", "NaN", "nan", "None", "null", "NULL")


@dataclass(frozen=True)
class WindowDef:
    """A labelled window: from the first start label to the first end label, less `inset` seconds at both ends."""

    name: str
    start: str
    end: str
    inset: float


# The labelled windows of the default study, in order.
LABELLED_WINDOWS = (
    WindowDef("p_baseline", "baseline_start", "p0", 30),
    WindowDef("g_t1", "baseline_start", "p0", 30),
    WindowDef("p_induction", "stim_start", "stim_end", 30),
    WindowDef("g_t2", "stim_end", "p2", 10),
    WindowDef("p_intervention", "intervention_start", "intervention_end", 30),
    WindowDef("g_recovery", "intervention_end", "p3", 5),
)


# The values of the four classes of rules below are fixed, as results depend on them.


@dataclass(frozen=True)
class BeatRules:
    """Thresholds for flagging, cleaning and scoring beat series (milliseconds, bpm, shares)."""

    relative: float = 0.20
    least_bpm: float = 35
    most_bpm: float = 140
    low: float = 510.0
    high: float = 2000.0
    jump: float = 150.0
    longest_run: int = 10
    median_rows: int = 11
    pair_tolerance: float = 0.15
    many_runs: int = 4
    many_corrected: float = 0.05
    both_bad: float = 0.15
    multiple_least: float = 1200.0
    multiple_most: int = 5
    multiple_tolerance: float = 0.12


@dataclass(frozen=True)
class ScoreRules:
    """Weights and scales that compare two beat sources."""

    flags: float = 0.50
    error: float = 0.30
    bias: float = 0.20
    most_error: float = 2.0
    most_bias: float = 1.0
    least_overlap: float = 10.0


@dataclass(frozen=True)
class SpectrumRules:
    rate: float = 4.0
    segment: int = 256
    least_points: int = 16
    low: tuple[float, float] = (0.04, 0.15)
    high: tuple[float, float] = (0.15, 0.40)
    radius: float = 0.05
    breath: tuple[float, float] = (0.1, 0.5)


@dataclass(frozen=True)
class BreathRules:
    """Respiration cleaning and breath detection."""

    rate: float = 50.0
    gap_factor: float = 3.0
    band: tuple[float, float] = (0.10, 0.50)
    least_seconds: float = 12.0
    least_cycles: int = 2
    segment_seconds: float = 20.0
    least_ratio: float = 0.20
    least_raw: float = 20.0
    least_filtered: float = 2.0
    least_prominence: float = 1.0
    most_variation: float = 0.40
    soft_cycles: int = 6
    soft_variation: float = 0.25
    most_disagreement: float = 6.0
    collapse_seconds: float = 8.0
    collapse_range: float = 10.0
    collapse_least: float = 2.0
    kept_share: float = 0.95
    plateau_tolerance: float = 1.0
    plateau_seconds: float = 0.08
    plateau_reach: float = 0.60
    smooth_seconds: float = 0.5
    least_bpm: float = 6.0
    most_bpm: float = 30.0
    least_beats: int = 2
    least_breaths: int = 2
    prominence_share: float = 0.1
    least_iqr: float = 1e-6


@dataclass(frozen=True)
class Scale:
    """A construct: the mean of items, or of other constructs; reversed items count as (low + high) - x."""

    items: tuple[str, ...]
    reverse: frozenset[str] = field(default_factory=frozenset)
