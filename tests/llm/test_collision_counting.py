import numpy as np
import pytest

from somaframe.llm import collision_counting as S


def reached(links):
    n = len(links)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in np.flatnonzero(links[i]))])
            if low < label[i]:
                label[i], changed = low, True
    return label


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(1000, 1000), (15, 1000), (1000, 25), (10, 7)])
def test_same_as_brute_force(spark, cell_rows, block_rows):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 32))
    x = np.concatenate([c + rng.normal(size=(15, 32)) * s for c, s in zip(centres, np.linspace(0.02, 0.4, 12), strict=True)] + [rng.normal(size=(60, 32))]).astype(np.float32)
    x[5] = x[6] = x[7]
    x[20] = 3 * x[21]
    label = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = (unit @ unit.T >= S.COSINE) & (label[:, None] == label)
    np.fill_diagonal(links, False)
    got = {r.vec_id: r for r in S.near_duplicates(df, cell_rows=cell_rows, block_rows=block_rows).collect()}
    assert [got[i].n_links for i in range(len(x))] == links.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == reached(links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5])
def test_collisions_by_hand(most):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(9, 7)), rng.normal(size=(150, 7))
    found = np.zeros((9, 150), bool)
    for rows, may in S._rows(S.misses(a, b, 0.9, most), 150):
        found[rows] = may
    assert (found == ((np.abs(a[:, None] - b[None]) > 0.9).sum(axis=2) <= most)).all()


def test_calibration():
    rng = np.random.default_rng(2)
    hits = (np.abs(rng.normal(size=(20_000, S.DIRECTIONS))) <= S.HALF_WINDOW).sum(axis=1)
    assert (hits < S.least_count()).mean() <= 5e-4
    assert S.grid(S.CELL_ROWS) == (0, 0, 1)
    for n in (10**4, 10**6, 10**9):
        sets, width, tables = S.grid(n)
        assert (2 * width) ** sets * S.CELL_ROWS >= n and tables < 60
        assert 1 - (1 - S.cell_rate(width) ** sets) ** tables > 0.999


def test_recall_of_planted_pairs(spark):
    """Pairs just above the threshold, in a label that is dealt to very many cells."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1500, 48))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * side
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in S.near_duplicates(df, cell_rows=30).collect()}
    assert sum(got[i].n_links >= 1 and got[i + 1500].component_id == got[i].component_id for i in range(1500)) >= 1498


def test_very_many_vectors_in_one_cell(spark):
    """20,000 different vectors around one direction, all linked with each other: one cell of every table, cut into blocks."""
    n = 20_000
    x = np.random.default_rng(4).normal(size=(n, 8)) * 0.01 + 1
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = S.near_duplicates(df).groupBy("n_links", "component_id").count().collect()
    assert [(r.n_links, r.component_id, r["count"]) for r in got] == [(n - 1, 0, n)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, nan], 1), (6, [1.0, inf], 1), (7, [1.0, None], 1), (8, [], 1), (9, [2.0, 0.0], 1), (9, [2.0, 0.0], 1), (None, [1.0, 0.01], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e-30, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS m", "2 AS id", "3 AS cell", "4 AS n", "5 AS component")
    got = sorted(((r.vec_id if r.vec_id is not None else -1), r.n_links, r.component_id, r.kept) for r in S.near_duplicates(df).collect())
    alone = {(d, 0, d, True) for d in (2, 3, 4, 5, 6, 7, 8, 11)}
    assert alone <= set(got)
    assert [g for g in got if g not in alone] == [(-1, 4, 1, False), (1, 4, 1, True), (9, 4, 1, False), (9, 4, 1, False), (12, 4, 1, False)]
    assert S.near_duplicates(df.limit(0)).count() == 0
