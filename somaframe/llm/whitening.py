"""Embedding whitening through MLlib's RowMatrix (operator 13).

Entries become integers on a grid, so that sums, and n times an entry less the sum, are exact. The fit list holds each distinct
vector once; its covariance is RowMatrix.computeGramianMatrix() of the exactly centred rows over n. The eigenvectors of that
matrix (dimension by dimension, whatever the number of rows) are found on the driver and broadcast; rows are projected in
mapInPandas. How far the whitened fit list is from unit covariance is measured by a RowMatrix of the whitened rows, centred in turn.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped, as are entries beyond the grid
(2^40 and more in size after scaling) and vectors of another length than most (the longer of two lengths as frequent);
repeated vectors count once in the fit, and each row gets its result; components without variance (under
LEAST_SHARE of the trace, so all of them if only one vector is left) are left out; a deviation beyond a long is null; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somaframe.llm._common import checkpoint, ship

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Components that explain less of the trace have no variance but for rounding.
LEAST_SHARE = 1e-12
GRID = 2.0**40


def on_grid(embeddings: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x, the vector as array<long>, of the rows that can be whitened."""
    sound = F.forall("embedding", lambda e: F.coalesce(F.abs(e.cast("double") * scale) < GRID, F.lit(False)))  # false for NaN, too
    x = F.when(sound, F.transform("embedding", lambda e: F.floor(e.cast("double") * scale) + shift))
    rows = embeddings.select("vec_id", x.alias("x")).where("size(x) > 0")
    usual = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == (usual["size"] if usual else 0))


def _matrix(lists: pa.Array) -> np.ndarray:
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1 if len(lists) else 0)


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """How many vectors there are, and the exact sum of each dimension; a task sends one row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if len(batch):
                n, total = n + len(batch), total + _matrix(batch.column(0)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], names=["i", "s", "n"])

    parts = fit.select("x").mapInArrow(run, "i long, s long, n long")
    found = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return (found[0].n, np.array([r.s for r in found])) if found else (0, np.zeros(0, np.int64))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: in 64 bits, or as Python integers where those might not do."""
    floor = sums // n
    x, rest = x - floor, sums - n * floor
    if len(x) and (int(np.abs(x).max()) + 1) * n >= 1 << 62:
        x, rest = x.astype(object), rest.astype(object)
    return x * n - rest


def squares(deviation: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null beyond a long."""
    if len(deviation) and (deviation.astype(float) ** 2).sum(axis=1).max() >= 2.0**62:
        deviation = deviation.astype(object)
    return [int(s) if s < 1 << 63 else None for s in (deviation * deviation).sum(axis=1)]


def covariance(rows: DataFrame, n: int) -> np.ndarray:
    """Of the n centred vectors in the only column of rows."""
    (name,) = rows.columns
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(name).alias(name)), name)
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


class Whitening:
    """What a fit keeps: sizes bounded by the number of dimensions."""

    def __init__(self, n: int, sums: np.ndarray, v: np.ndarray, most: int):
        self.n, self.sums = n, sums
        value, vector = np.linalg.eigh((v + v.T) / 2)
        value, vector = value[::-1], vector[:, ::-1]
        keep = min(most, int((value > LEAST_SHARE * np.trace(v)).sum()))
        value, vector = value[:keep], vector[:, :keep]
        vector = vector * np.where(vector[np.abs(vector).argmax(axis=0), np.arange(keep)] < 0, -1.0, 1.0)  # one of both signs, always the same
        self.scaled = vector / np.sqrt(value)
        self.explained = value / np.trace(v)

    def whitened(self, deviation: np.ndarray) -> np.ndarray:
        return (deviation / self.n).astype(float) @ self.scaled


def fit(distinct: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors x; none if there is no vector."""
    n, sums = _sums(distinct)
    if not n:
        return None

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = (deviations(_matrix(batch.column(0)), n, sums) / n).astype(float)
            yield pa.RecordBatch.from_arrays([_lists(d)], names=["c"])

    return Whitening(n, sums, covariance(distinct.select("x").mapInArrow(centre, "c array<double>"), n), most)


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, matrix.shape[1] or 1, dtype=np.int32), pa.array(matrix.ravel())) if matrix.shape[1] else pa.array([[]] * len(matrix), pa.list_(pa.float64()))


def identity_error(distinct: DataFrame, found: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    if not len(found.explained):
        return 0.0
    shared = distinct.sparkSession.sparkContext.broadcast(found)

    def project(mean: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            for batch in batches:
                yield pa.RecordBatch.from_arrays([_lists(w.whitened(deviations(_matrix(batch.column(0)), w.n, w.sums)) - mean)], names=["c"])

        return distinct.select("x").mapInArrow(run, "c array<double>")

    vectors = MLUtils.convertVectorColumnsFromML(project(np.zeros(1)).select(array_to_vector("c").alias("c")), "c")
    mean = RowMatrix(vectors).computeColumnSummaryStatistics().mean()
    return float(np.abs(covariance(project(np.asarray(mean)), found.n) - np.eye(len(mean))).max())


SCHEMA = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = on_grid(embeddings)
    schema = SCHEMA.format(dict(rows.dtypes)["vec_id"])
    distinct = checkpoint(rows.select("x").distinct())
    found = fit(distinct, most)
    if found is None:
        return spark.createDataFrame([], schema)
    error = identity_error(distinct, found)
    shared = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        k = len(w.explained)
        for batch in batches:
            if k and len(batch):
                deviation = deviations(np.stack(batch["x"].to_numpy()), w.n, w.sums)
                once = pd.DataFrame({"vec_id": batch["vec_id"].to_numpy(), "deviation": pd.array(squares(deviation), dtype="Int64")})
                out = once.loc[once.index.repeat(k)]
                yield pd.DataFrame({
                    "vec_id": out["vec_id"].to_numpy(), "component": np.tile(np.arange(1, k + 1), len(batch)), "n": w.n, "deviation": out["deviation"].array,
                    "whitened": w.whitened(deviation).ravel(), "explained": np.tile(w.explained, len(batch)), "identity_error": error,
                })

    return rows.mapInPandas(run, schema)
