"""Document fingerprints by quartile bucket digests (operator 3).

Every window of five bytes counts six byte triplets, hashed into 128 buckets. The digest holds the
length on a logarithmic scale, how the first two quartiles of the counts relate to the third, and for
each bucket the quartile of its count (two bits). Digests are compared with a bounded difference score.

Defined cases: a null text is an empty one; a text is padded with four zero bytes, so that texts under
five bytes have triplets too; equal texts have equal digests; rows may repeat (each is a row of its own,
ordered by doc_id, then text; a null doc_id comes first); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somaframe.llm._common import CHUNK_BYTES, ship, shuffle_partitions

BUCKETS = 128
#: Which bytes of a window make a triplet: offsets from its first byte.
TRIPLETS = ((4, 3, 2), (4, 3, 1), (4, 2, 1), (4, 2, 0), (4, 3, 0), (4, 1, 0))
LENGTH_STEP = 1.15  # a length code grows by one each time the length grows by this factor
#: Largest parts of a difference score: the length, each quartile relation, the buckets.
MOST_LENGTH, MOST_RATIO, WORST_BUCKET = 48, 24, 6
MOST = MOST_LENGTH + 2 * MOST_RATIO + WORST_BUCKET * BUCKETS
#: Range boundaries that the driver holds at most (8 bytes each).
MOST_RANGES = 10_000
FIRST = -(1 << 63)  # stands for a null doc_id, which is ordered first

_RNG = np.random.Generator(np.random.PCG64(128))
_PERMUTED = _RNG.permutation(256).astype(np.uint8)
#: For each triplet kind, the hash of its first two bytes.
_PAIRS = [_PERMUTED[_PERMUTED[np.arange(65536) >> 8] ^ (np.arange(65536) & 255) ^ salt] for salt in (2, 3, 5, 7, 11, 13)]


def counts(texts: list[bytes]) -> np.ndarray:
    """Bucket counts, one row for each text."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK_BYTES // 4):
            size += len(texts[j]) + 4
            j += 1
        sizes = np.array([len(t) for t in texts[i:j]])
        data = np.frombuffer(b"".join(t + b"\0\0\0\0" for t in texts[i:j]) + b"\0\0\0\0", np.uint8)
        n = len(data) - 4
        row = np.repeat(np.arange(j - i, dtype=np.int32) * BUCKETS, sizes + 4)
        live = np.ones(n, bool)  # a window must not reach into the next text
        ends = np.cumsum(sizes + 4)
        for k in range(1, 5):
            live[ends - k] = False
        at = np.flatnonzero(live)
        row = row[at]
        parts = [data[k : k + n][at] for k in range(5)]
        wide = {k: parts[k].astype(np.uint16) << np.uint16(8) for k in (4,)}
        total = np.zeros((j - i) * BUCKETS, np.int64)
        for kind, (a, b, c) in enumerate(TRIPLETS):
            h = _PERMUTED[_PAIRS[kind][wide[a] | parts[b]] ^ parts[c]]
            total += np.bincount(row + (h & np.uint8(BUCKETS - 1)), minlength=len(total))
        out[i:j] = total.reshape(-1, BUCKETS)
        i = j
    return out


def digests(texts: list[bytes]) -> np.ndarray:
    """One row of 4 + 128 small integers for each text: length code, two quartile relations, 0, bucket quartiles."""
    if not texts:
        return np.zeros((0, 4 + BUCKETS), np.int16)
    c = counts(texts)
    s = np.sort(c, axis=1)
    q1, q2, q3 = (s[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    out = np.zeros((len(texts), 4 + BUCKETS), np.int16)
    size = np.array([len(t) for t in texts])
    out[:, 0] = np.minimum(255, np.floor(np.log(np.maximum(size, 1)) / np.log(LENGTH_STEP)) + (size > 0))
    top = np.maximum(q3, 1)
    out[:, 1], out[:, 2] = q1 * 15 // top, q2 * 15 // top
    for q in (q1, q2, q3):
        out[:, 4:] += c > q[:, None]
    return out


def text_of(digest: np.ndarray) -> list[str]:
    """Digests as hexadecimal strings: length (2), relations (1 each), buckets (64 digits, two buckets each)."""
    head = [f"{a:02x}{b:x}{c:x}" for a, b, c in digest[:, :3].tolist()]
    body = (digest[:, 4::4] << 6 | digest[:, 5::4] << 4 | digest[:, 6::4] << 2 | digest[:, 7::4]).astype(np.uint8)
    return [h + b.tobytes().hex() for h, b in zip(head, body, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the difference score over its bound; row by row."""
    d = np.abs(a.astype(np.int64) - b)
    buckets = d[:, 4:].sum(axis=1) + 3 * (d[:, 4:] == 3).sum(axis=1)
    length = np.minimum(MOST_LENGTH, 4 * d[:, 0])
    ratios = np.minimum(MOST_RATIO, 4 * d[:, 1]) + np.minimum(MOST_RATIO, 4 * d[:, 2])
    return 1.0 - (buckets + length + ratios) / MOST


def in_ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, bucket, ahead: rows dealt by ranges of doc_id, and again (ahead) the first document of each
    range to the range before, the very first to the last."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(FIRST)).alias("_at"))
    wanted = min(MOST_RANGES, max(2, shuffle_partitions(docs.sparkSession)))
    found = docs.agg(F.percentile_approx("_at", [i / wanted for i in range(1, wanted)], 100 * wanted).alias("at"), F.min("_at").alias("least")).first()
    if found.least is None:
        return docs.withColumns({"bucket": F.lit(0), "ahead": F.lit(False)}), 1
    bounds = np.unique([b for b in found["at"] if b > found.least]).astype(np.int64)
    starts = np.append(np.int64(found.least), bounds)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ranges(at: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, at.to_numpy(), "right")
        first = starts[own] == at.to_numpy()
        return pd.Series([[o, (o - 1) % len(starts)] if f else [o] for o, f in zip(own, first, strict=True)])

    return docs.select("*", F.posexplode(ranges("_at")).alias("_n", "bucket")).withColumn("ahead", F.col("_n") == 1), len(starts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every document: its digest, that of its text with the last quarter of the characters replaced by the
    first ones of the next document in the order of doc_id, and how like they are."""
    ship(docs.sparkSession)
    dealt, n = in_ranges(docs)
    dealt = dealt.repartitionById(n, "bucket").sortWithinPartitions("bucket", "ahead", "_at", "text").select("doc_id", "text", "bucket", "ahead")
    kinds = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([kinds["doc_id"], T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one range whose successor has not been seen yet, or not been worked on

        def out(rows: list[tuple]) -> pa.RecordBatch:
            """The last row is only a successor."""
            texts = [r[1] for r in rows]
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            edited = []
            for t, after in zip(texts, texts[1:], strict=False):
                k = len(t) // 4
                edited.append((t[: len(t) - k] + after[:k]).encode("utf-8", "surrogatepass"))
            own, new = digests(raw), digests(edited)
            names, columns = schema.names, [[r[0] for r in rows[:-1]], [len(t) for t in texts[:-1]], [hashlib.sha256(e).hexdigest() for e in edited], text_of(own[:-1]), text_of(new), likeness(own[:-1], new), likeness(own[:-1], own[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=names)

        kind = pa.int64()
        size, closed = 0, False
        for batch in batches:
            kind = batch.column(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[3]:
                    if not closed:  # of several rows ahead (equal doc_id) the first counts
                        yield out([*held, row])
                        held, closed, size = [], True, 0
                    continue
                closed = False
                held.append(row)
                size += len(row[1])
                if size > 2 << 20:
                    yield out(held)
                    held, size = [row], len(row[1])

    return dealt.mapInArrow(run, schema)
