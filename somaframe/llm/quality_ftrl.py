"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader (operator 5).

Words are runs of letters, digits and other non-ASCII bytes, or runs of punctuation. Features are hashes of
words, of pairs and of triples of words, in 2^BITS buckets. A document's value of each bucket that it has is one over the square
root of how many n-grams it has, repeats included: the more a text repeats itself, the smaller its values, and there is no constant that
would speak for a text of which nothing is known. Training runs the updates (per-coordinate rates,
L1 and L2) on shards of labelled documents, in several passes, and averages the shards' weights. A score is the logistic of a sparse dot product.

The labelled rows learned from are a bounded sample: MOST_ROWS documents at most in expectation, drawn by
a hash of doc_id. Everything else covers all rows. The model has 2^BITS weights whatever the input.

Defined cases: null texts are empty; a text without words has a score of 0.5; of several
labels of a document their mean counts, null labels do not; of several rows with a doc_id the lowest text is
learned from; documents without a doc_id are scored, never learned from; without labels every score is 0.5;
repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somaframe.llm._common import Rolling, chunks, mix64, ship, text_bytes

BITS = 18
ORDERS = 3
MOST_ROWS = 20_000
#: Rows of a shard, whose updates follow each other, and how often each row is learned from.
SHARD_ROWS, PASSES = 4_000, 5
#: Learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.1, 0.1
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.int8)
_CLASS[33:] = 2  # punctuation
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_lo:_hi] = 1  # word bytes
_ROLLING = Rolling(5)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that each text has, in order; where each text's begin and the last's end; and how many n-grams each has."""
    n = len(data)
    kind = _CLASS[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    begin, end = cuts[:-1], cuts[1:]
    word = kind[begin] != 0 if n else np.zeros(0, bool)
    begin, end = begin[word], end[word]
    words = np.diff(np.searchsorted(begin, at))
    h = gram = _ROLLING.hashes(data, begin, end)
    owner = np.repeat(np.arange(len(at) - 1), words)
    keys = []
    for order in range(1, ORDERS + 1):
        if order > 1:
            gram = mix64(gram[:-1] * np.uint64(3) + h[order - 1 :])
        own = owner[order - 1 :]
        same = own == owner[: len(own)]
        keys.append(own[same] << BITS | (gram[same] >> np.uint64(64 - BITS)).astype(np.int64))
        if order >= len(h):
            break
    key = np.unique(np.concatenate(keys))
    total = sum(np.maximum(words - k, 0) for k in range(ORDERS))
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(at)) << BITS), total


def scores(data: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    bucket, first, total = features(data, at)
    sums = np.concatenate([[0.0], np.cumsum(weights[bucket], dtype=np.float64)])
    logit = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(total, 1))
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class Leader:
    """Follow-the-regularised-leader state: sums of shifted and of squared gradients."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[index]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(self.n[index])) / ALPHA + L2)

    def learn(self, index: np.ndarray, value: float, label: float) -> None:
        """One document, whose features all have one value."""
        w = self.weights(index)
        g = (1 / (1 + np.exp(-np.clip(w.sum() * value, -30, 30))) - label) * value
        rate = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / ALPHA
        self.z[index] += g - rate * w
        self.n[index] += g * g


def in_test_part(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into the part that is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> np.ndarray:
    """2^BITS weights, from labelled documents outside the held-out part."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_test_part(F.col("doc_id"), 4, 2))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most_rows / max(1, n)))
    known = known.where(draw)
    shards = -(-max(1, min(n, most_rows)) // SHARD_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # MOST_ROWS pairs of numbers
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.any_value("y").alias("y"))  # a doc_id may stand in very many rows
    rows = rows.withColumns({"shard": F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(shards)), "_h": F.xxhash64("doc_id", F.lit(7))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, float, float]]] = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                bucket, first, total = features(*text_bytes(part.column(1)))
                for i, (shard, y) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    own = bucket[first[i] : first[i + 1]].copy()
                    held.setdefault(shard, []).append((own, 1 / np.sqrt(max(1, total[i])), y))
        for rows in held.values():
            leader = Leader()
            for _ in range(PASSES):
                for row in rows:
                    leader.learn(*row)
            w = leader.weights()
            some = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(w[some], 1.0))], names=["index", "w"])

    trained = rows.repartition(shards, "shard").sortWithinPartitions("shard", "_h", "text").select("shard", "text", "y").mapInArrow(run, "index long, w double")
    found = trained.groupBy("index").agg(F.sum("w").alias("w")).toPandas()  # 2^BITS rows at most
    w = np.zeros(1 << BITS)
    if len(found):
        trained_shards = found.loc[found["index"] == -1, "w"].iloc[0]
        found = found[found["index"] >= 0]
        w[found["index"].to_numpy()] = found["w"].to_numpy() / trained_shards
    return w


def score(docs: DataFrame, weights: np.ndarray, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keys` and score."""
    spark = docs.sparkSession
    ship(spark)
    shared: Broadcast = spark.sparkContext.broadcast(weights.astype(np.float32))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keys))), pa.array(scores(*text_bytes(part.column(len(keys))), w))], names=[*keys, "score"])

    return docs.select(*keys, "text").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "score double"]))


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels, most_rows=most_rows)).select(
        "doc_id", in_test_part(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
