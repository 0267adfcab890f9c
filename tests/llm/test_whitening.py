import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from somaframe.llm import whitening as W
from somaframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Exact sums in Python integers; covariance from exact rational centring; eigenvectors by numpy."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    centred = np.array([[(n * x[i] - s[i]) / n for i in range(d)] for x in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    out = {}
    for i, x in kept:
        dev = [n * x[k] - s[k] for k in range(d)]
        white = (np.array([a / n for a in dev]) @ u / np.sqrt(np.maximum(e, 1e-300)))[::-1]
        out.setdefault(i, []).append((n, sum(a * a for a in dev), white))
    return out, e[::-1] / np.trace(v)


def compare(rows, got, most=16):
    want, explained = brute(rows)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    top = {c for _, c in by}
    assert top == set(range(1, min(most, int((explained > 1e-12).sum())) + 1))
    assert {i for i, _ in by} == set(want)
    for c in top:
        pairs = [(r, w) for i in want for r, w in zip(by[i, c], want[i], strict=True)]
        assert all(r.n == w[0] and r.deviation == w[1] for r, w in pairs)
        assert all(r.explained == pytest.approx(explained[c - 1], rel=1e-9) for r, _ in pairs)
        assert all(r.identity_error < 1e-9 for r, _ in pairs)
        a, b = np.array([r.whitened for r, _ in pairs]), np.array([w[2][c - 1] for _, w in pairs])
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)


def test_query_same_as_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = QUERIES["op13_rowmatrix_whitening"](spark, SF).collect()
    compare([(r.vec_id, r.embedding) for r in table.collect()], got)


def test_unit_covariance(spark):
    """Of all distinct vectors together, by plain numpy over the query's rows."""
    got = QUERIES["op13_rowmatrix_whitening"](spark, SF).toPandas()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").join(got[got.component == 1].set_index("vec_id").deviation)
    distinct = wide.round(9).drop_duplicates().drop(columns="deviation").to_numpy()
    assert len(distinct) == got.n.iloc[0]
    assert np.abs(np.cov(distinct.T, bias=True) - np.eye(16)).max() < 1e-6


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).astype("f4").tolist(), 1) for i in range(30)]
    rows += [(i, rows[3][1], None) for i in range(100, 160)]  # copies: a group of many rows counts once
    rows += [(None, rows[4][1], 1), (3, rows[3][1], 1), (200, None, 1), (201, [nan, 1.0, 1.0, 1.0, 1.0], 1), (202, [1.0, inf, 1.0, 1.0, 1.0], 1), (203, [None, 1.0, 1.0, 1.0, 1.0], 1), (204, [], 1), (205, [1.0, 2.0], 1), (206, [0.0] * 5, 1)]
    return rows, spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("x", "n", "component", "c", "size")})


def test_odd(odd_vectors):
    rows, df = odd_vectors
    got = W.whiten(df).collect()
    sound = [(i, v) for i, v, _ in rows if v is None or len(v) == 5]
    assert {r.vec_id for r in got} == {*range(30), *range(100, 160), None, 206}
    compare(sound, got)


def test_empty_and_one_vector(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)
    assert W.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 1) for i in range(6)], SCHEMA)
    assert {r.component for r in W.whiten(line).collect()} == {1}  # two of three directions have no variance


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, -(1 << 40)], [0, 5]])
    n, s = 1 << 24, np.array([12345, -678])
    got = W.deviations(x, n, s)
    assert [[int(v) for v in row] for row in got] == [[n * int(v) - int(t) for v, t in zip(row, s, strict=True)] for row in x]
    assert W.squares(got)[0] is None and W.squares(np.array([[3, 4]])) == [25]
