"""Quality rules: gradient-boosted trees over document statistics (operator 11).

Every text is counted once (words, symbols, lines and words that repeat, ...). Fixed base rules fail very short and very repetitive
texts. For the rest the verdict is that of boosted trees over shares of those counts: a split of a feature whose sign in
FEATURES is -1 may only lower the score for higher values, in every tree and below every node (values of nodes are
kept between bounds that such splits hand down). Trees are complete, so a model is three arrays (feature and threshold of each
inner node, value of each leaf), and scoring takes one gather a level for all documents and trees of a batch.

The labelled rows learned from are a bounded sample: MOST_ROWS in expectation, drawn by a hash of doc_id, outside the held-out
part (crc32 of the id modulo 4 is 2). What reaches the driver is their features, 8 * len(FEATURES) bytes a row; counting and scoring
cover all rows, and their memory is bounded by the longest text.

Defined cases: a null text has no words; windows of eight words do not cross texts, and a text of fewer words has none;
a line counts as repeated if it equals an earlier one whole, blanks included; of several labels of a document their mean counts,
null labels do not; of several rows with a doc_id the lowest text is learned from; documents without a doc_id are never learned from;
without labels every score is 0.5, which keeps; repeated rows get equal results; other columns are passed through.
Equal words, lines and windows are told by 64-bit hashes within a text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somaframe.llm._common import CHUNK_BYTES, Rolling, mix64, safely_named, ship, text_bytes
from somaframe.llm.quality_ftrl import in_test_part

WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
MOST_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 64
#: Least rows on each side of a split, and the penalty of a node's value.
LEAST_ROWS, PENALTY = 20, 1.0
KEEP = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_twins", "n_upper", "n_letters", "n_digits", "n_points")
#: Features of the trees, and the sign of their effect on quality where it is constrained.
FEATURES: dict[str, tuple[Callable[[dict[str, np.ndarray]], np.ndarray], int]] = {
    "words": (lambda c: np.log1p(c["n_words"]), 0),
    "word_length": (lambda c: _share(c["word_chars"], c["n_words"]), 0),
    "symbols": (lambda c: _share(c["n_symbols"], c["n_words"]), -1),
    "dup_lines": (lambda c: _share(c["n_dup_lines"], c["n_lines"]), -1),
    "repeat_words": (lambda c: _share(c["n_repeat_words"], c["n_words"]), -1),
    "twins": (lambda c: _share(c["n_twins"], c["n_words"]), -1),
    "upper": (lambda c: _share(c["n_upper"], c["n_letters"]), -1),
    "digits": (lambda c: _share(c["n_digits"], c["word_chars"]), 0),
    "points": (lambda c: _share(c["n_points"], c["n_words"]), 0),
    "distinct": (lambda c: _share(c["n_distinct"], c["n_words"]), 0),
    "line_words": (lambda c: np.log1p(_share(c["n_words"], c["n_lines"])), 0),
}
_SIGNS = np.array([sign for _, sign in FEATURES.values()])


def _of(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars.encode(), np.uint8)] = True
    return table


_BYTE = np.arange(256)
_WORD = ~_of(" \t\n\v\f\r")
_UPPER = _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Bytes that each of these counts counts.
_TALLIED = {
    "word_chars": _WORD & ((_BYTE & 0xC0) != 0x80), "n_symbols": _of("#*$%&|<>"), "n_upper": _UPPER, "n_letters": _UPPER | _UPPER[_BYTE ^ 32],
    "n_digits": _of("0123456789"), "n_points": _of(".,;:!?"),
}
_ROLLING = Rolling(11)


def _share(part: np.ndarray, of: np.ndarray) -> np.ndarray:
    return part / np.maximum(of, 1)


def _cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Where words begin and end, and how many bytes of each kind the texts have; a block of bytes at a time."""
    begins, ends, before = [], [], False
    tallies = {name: np.zeros(len(at) - 1, np.int64) for name in _TALLIED}
    for lo in range(0, len(data), CHUNK_BYTES):
        part = data[lo : lo + CHUNK_BYTES]
        word = np.append(before, _WORD[part])
        fresh = np.zeros(len(part), bool)
        fresh[at[np.searchsorted(at, lo) : np.searchsorted(at, lo + len(part))] - lo] = True
        begins.append(np.flatnonzero(word[1:] & (~word[:-1] | fresh)) + lo)
        ends.append(np.flatnonzero(word[:-1] & (~word[1:] | fresh)) + lo)
        before = word[-1]
        for name, table in _TALLIED.items():
            tallies[name] += np.diff(np.searchsorted(np.flatnonzero(table[part]) + lo, at))
    if before:
        ends.append(np.array([len(data)]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *begins]), np.concatenate([none, *ends]), tallies


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys equal to an earlier one, and of all keys that stand more than once."""
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key) + 1, bool)
    again[1:-1] = key[order][1:] == key[order][:-1]
    return order[again[:-1]], order[again[:-1] | again[1:]]


def counted(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    n = len(at) - 1
    begin, end, out = _cuts(data, at)
    per_text = lambda owner: np.bincount(owner, minlength=n)[:n].astype(np.int64)
    text_of = lambda place: np.searchsorted(at[1:], place, "right").astype(np.int32)
    owner, h = text_of(begin), _ROLLING.hashes(data, begin, end)
    out["n_words"] = per_text(owner)
    out["n_twins"] = per_text(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])])
    salt = mix64(owner.astype(np.uint64) + np.uint64(1))
    out["n_distinct"] = out["n_words"] - per_text(owner[_repeats(h ^ salt)[0]])
    windows = max(0, len(h) - WINDOW + 1)
    key = np.zeros(windows, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + windows]
    inside = np.flatnonzero(owner[:windows] == owner[WINDOW - 1 :]) if windows else np.zeros(0, np.int64)
    twice = inside[_repeats(mix64(key[inside]) ^ salt[inside])[1]]
    edges = np.bincount(twice, minlength=len(h) + 1)[: len(h) + 1].astype(np.int32)
    edges[WINDOW:] -= edges[:-WINDOW].copy() if len(edges) > WINDOW else 0
    out["n_repeat_words"] = per_text(owner[np.cumsum(edges[: len(h)]) > 0])
    breaks = np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero(data[lo : lo + CHUNK_BYTES] == 10) + lo for lo in range(0, len(data), CHUNK_BYTES))])
    first, last = np.sort(np.concatenate([at[:-1], breaks + 1])), np.sort(np.concatenate([breaks, at[1:]]))
    some = np.searchsorted(begin, last) > np.searchsorted(begin, first)
    first, last = first[some], last[some]
    line_of = text_of(first)
    out["n_lines"] = per_text(line_of)
    line = _ROLLING.hashes(data, first, last) ^ mix64(line_of.astype(np.uint64) + np.uint64(1))
    out["n_dup_lines"] = per_text(line_of[_repeats(line)[0]])
    return out


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([f(counts) for f, _ in FEATURES.values()], axis=1)


class Trees:
    """A model: a start, and complete trees of one depth as arrays over (tree, node)."""

    def __init__(self, start: float, depth: int = DEPTH):
        self.start, self.depth = start, depth
        self.feature, self.threshold, self.value = np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth))

    def add(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> None:
        self.feature, self.threshold, self.value = (np.vstack([a, b]) for a, b in ((self.feature, feature), (self.threshold, threshold), (self.value, value)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.value))[None]
        node = np.zeros((len(x), len(self.value)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.start + self.value[trees, node - (2**self.depth - 1)].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def _best_split(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, low: float, high: float) -> tuple[int, int, float, float] | None:
    """Feature, last bin of the left side, and both values, from a node's histograms (feature, bin); none if nothing is gained."""
    g, h, n = (np.cumsum(a, axis=1) for a in (grad, hess, rows))
    sides = [(g, h, n), tuple(a[:, -1:] - a for a in (g, h, n))]
    left, right = (np.clip(-gs / (hs + PENALTY), low, high) for gs, hs, _ in sides)
    gain = sum(-(gs * v + (hs + PENALTY) * v * v / 2) for (gs, hs, _), v in zip(sides, (left, right), strict=True))
    allowed = (sides[0][2] >= LEAST_ROWS) & (sides[1][2] >= LEAST_ROWS) & (_SIGNS[:, None] * (right - left) >= 0)
    whole = float(np.clip(-g[0, -1] / (h[0, -1] + PENALTY), low, high))
    none = -(g[0, -1] * whole + (h[0, -1] + PENALTY) * whole * whole / 2)
    gain = np.where(allowed, gain - none, 0.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(f), int(b), float(left[f, b]), float(right[f, b])) if gain[f, b] > 1e-9 else None


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Trees for labels y of 0 and 1, each a Newton step from histograms of the gradients, split level by level."""
    good = float(y.sum())
    model = Trees(float(np.log((good + 1) / (len(y) - good + 1))))
    if not len(y) or good in (0, len(y)):
        return model
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # bin b: above edge b - 1, up to edge b
    cell = binned + BINS * np.arange(x.shape[1])
    logit, inner = np.full(len(y), model.start), 2**model.depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = p - y, p * (1 - p)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2 * inner + 1)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        node = np.zeros(len(y), np.int64)
        value[0] = np.clip(-grad.sum() / (hess.sum() + PENALTY), low[0], high[0])
        for at in range(inner):
            own = np.flatnonzero(node == at)
            l, r = 2 * at + 1, 2 * at + 2
            low[[l, r]], high[[l, r]], value[[l, r]] = low[at], high[at], value[at]
            if len(own) >= 2 * LEAST_ROWS:
                size = x.shape[1] * BINS
                parts = (np.bincount(cell[own].ravel(), None if w is None else np.repeat(w[own], x.shape[1]), size).reshape(-1, BINS) for w in (grad, hess, None))
                if (found := _best_split(*parts, low[at], high[at])) is not None:
                    f, b, value[l], value[r] = found
                    feature[at], threshold[at] = f, edges[f][b]
                    if _SIGNS[f]:
                        middle = (value[l] + value[r]) / 2
                        (high if _SIGNS[f] > 0 else low)[l] = middle
                        (low if _SIGNS[f] > 0 else high)[r] = middle
            node[own] = 2 * at + 1 + (x[own, feature[at]] > threshold[at])
        model.add(feature, threshold, RATE * value[inner:])
        logit += RATE * value[node]
    return model


_RESULT = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("score", T.DoubleType())])


def _udf(model: Callable[[], Trees]):
    """An Arrow function from texts to their counts and score; blocks of texts keep its arrays small."""

    @F.arrow_udf(_RESULT)
    def rated(text: pa.Array) -> pa.Array:
        data, at = text_bytes(text)
        parts, i, trees = [], 0, model()
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
            c = counted(data[at[i] : at[j]], at[i : j + 1] - at[i])
            parts.append([c[name] for name in COUNTS] + [trees.scores(features(c))])
            i = j
        columns = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(COUNTS) + [np.zeros(0)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=_RESULT.names)

    return rated


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Trees:
    """Trees from labelled documents outside the held-out part."""
    ship(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_test_part(F.col("doc_id"), 4, 2))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most_rows / max(1, known.count())))
    rows = docs.select("doc_id", "text").join(F.broadcast(known.where(draw)), "doc_id")  # MOST_ROWS pairs of numbers
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.any_value("y").alias("y"))
    start = Trees(0.0)
    found = rows.select("doc_id", "y", _udf(lambda: start)("text").alias("c")).select("doc_id", "y", "c.*").toPandas().sort_values("doc_id")
    return boost(features({name: found[name].to_numpy() for name in COUNTS}), found["y"].to_numpy())


def rated(docs: DataFrame, model: Trees, keep: float = KEEP) -> DataFrame:
    """docs with COUNTS, score, base_failed and kept."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named, restored = safely_named(docs, "doc_id", "text")
    found = named.withColumn("_r", _udf(lambda: shared.value)("text"))
    n, again, score = F.col("_r.n_words"), F.col("_r.n_repeat_words"), F.col("_r.score")
    failed = (n < LEAST_WORDS) | (100 * again > MOST_REPEATED_PERCENT * n)
    ours = {**{name: F.col(f"_r.{name}") for name in COUNTS}, "score": score, "base_failed": failed, "kept": ~failed & (score >= keep)}
    return found.select(*(c for c, name in zip(restored, docs.columns, strict=True) if name not in ours), *(c.alias(name) for name, c in ours.items()))
