"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somaframe.functions.shipping import ship  # noqa: F401

#: Word separators of the contracts: blank and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a numpy pass takes at once, so that its arrays stay in tens of MB.
CHUNK_BYTES = 1 << 20
#: Bits of a filter for each key in it, and how many it has at most (16 MB): beyond that it lets more rows pass, and loses none.
FILTER_BITS, MOST_BITS = 16, 1 << 27
#: Keys that one task puts into such a filter.
FILTER_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def safely_named(docs: DataFrame, *keep: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but `keep` renamed, so that no column of the input clashes with one that an operator
    adds; and the columns that restore the names."""
    names = [c if c in keep else f"_other_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the folder that spark.checkpoint.dir names.

    Only on one machine, where that setting is absent (tests), a temporary folder is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="somaframe-checkpoint-"))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(many: DataFrame, one: DataFrame, on: list[str], how: str, seed: list[str], salts: int = 16) -> DataFrame:
    """Join where `many` may hold very many rows of a key and `one` has one: rows of a key are dealt to parts by a
    hash of the columns `seed`, and the one row is repeated for each part."""
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(*seed), F.lit(salts)))
    repeated = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")


def maybe_in(wanted: DataFrame, of: list[Column], keys: list[Column]) -> Column:
    """Whether a row's `keys` may be among the columns `of` of wanted: true for all that are, and for one in FILTER_BITS of the others. A
    join of wide rows with few wanted ones then moves little more than those. wanted is read twice."""
    n = wanted.count()
    places = min(MOST_BITS, max(1 << 15, 1 << (FILTER_BITS * n).bit_length()))
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(places).cast("long"))
    wanted = wanted.select((place(of) + 1).alias("at")).coalesce(n // FILTER_ROWS + 1)  # few keys: few tasks
    found = wanted.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros((places >> 15, 1 << 12), np.uint8)
    for k, part in found.collect():  # 4 KB each
        bits[k - 1] = np.frombuffer(part, np.uint8)
    held = wanted.sparkSession.sparkContext.broadcast(bits.ravel())

    @F.arrow_udf(T.BooleanType())
    def there(at: pa.Array) -> pa.Array:
        at = at.to_numpy(zero_copy_only=False)
        return pa.array((held.value[at >> 3] >> (at & 7) & 1).astype(bool))

    return there(place(keys))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins and the last ends; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts have about `limit` bytes, one row at least."""
    _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of byte ranges from prefix sums of b[i] * base^i modulo 2^64, each byte mapped to a random word."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.words = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self._base, self._inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self._up) < n:
            step = len(self._up)
            self._up = np.concatenate([self._up, self._up * np.uint64(pow(self._base, step, 1 << 64))])
            self._down = np.concatenate([self._down, self._down * np.uint64(pow(self._inverse, step, 1 << 64))])

    def sums(self, data: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """n + 1 prefix sums."""
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.words if words is None else words)[data] * self._up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each range [begin, end): equal bytes give equal hashes, wherever they stand."""
        return mix64((sums[end] - sums[begin]) * self._down[begin] + (end - begin).astype(np.uint64))

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, block: int = CHUNK_BYTES) -> np.ndarray:
        """ranges() of ascending ranges that do not overlap, with sums over a block at a time: 16 bytes for each range, not
        for each byte. A range over several blocks is the sum of its parts."""
        out = np.zeros(len(begin), np.uint64)
        for lo in range(0, len(data), block):
            hi = min(lo + block, len(data))
            i, j = int(np.searchsorted(end, lo, "right")), int(np.searchsorted(begin, hi, "left"))
            if i < j:
                sums = self.sums(data[lo:hi])
                b, e = np.maximum(begin[i:j], lo) - lo, np.minimum(end[i:j], hi) - lo
                part = (sums[e] - sums[b]) * self._down[b]
                if begin[i] < lo:  # only the first can have begun before
                    part[:1] *= np.array([pow(self._base, lo - int(begin[i]), 1 << 64)], np.uint64)
                out[i:j] += part
        return mix64(out + (end - begin).astype(np.uint64))
