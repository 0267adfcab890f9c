import heapq
import random

import pytest
from pyspark.sql import functions as F

from somaframe.llm import source_mix as S


def highest_quotients(claims, seats):
    got = dict.fromkeys(claims, 0)
    heap = [(-c, p) for p, c in claims.items() if c > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        _, p = heapq.heappop(heap)
        got[p] += 1
        heapq.heappush(heap, (-claims[p] / (2 * got[p] + 1), p))
    return got


@pytest.mark.parametrize("seats", [0, 1, 3, 10, 57, 1000])
def test_apportionment_is_by_highest_quotients(spark, seats):
    rng = random.Random(seats)
    claims = {p: rng.choice([0, 1, rng.random() * 1000, rng.random()]) for p in range(12)}
    df = spark.createDataFrame([(p, float(c)) for p, c in claims.items()], "p int, c double")
    got = {r.p: r.quota for r in S.apportion(df, [], "p", F.col("c"), F.lit(seats)).collect()}
    assert got == highest_quotients(claims, seats)


def shared(sizes, weights=S.WEIGHTS, most=S.MOST):
    total, open_, target = sum(sizes), dict(enumerate(sizes)), {}
    while open_:
        rate = (total - sum(target.values())) / sum(weights[i % 3] for i in open_)
        full = [i for i in open_ if weights[i % 3] * rate >= most * sizes[i]]
        if not full:
            return [target.get(i, weights[i % 3] * rate) for i in range(len(sizes))]
        for i in full:
            target[i] = most * open_.pop(i)
    return [target[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[10, 500, 900, 30, 4], [100, 100, 100], [0, 7, 100000], [5]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(chr(97 + i), s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in S.targets(df).orderBy("source").collect()]
    assert got == pytest.approx(shared(sizes))


def test_mix(documents):
    once, again = (sorted(S.mix(documents).collect(), key=str) for _ in range(2))
    assert once == again
    taken = {}
    for r in once:
        assert 0 <= r.taken <= 3 * r.size
        t = taken.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    assert len(once) == documents.count()
    assert all(abs(a - b) <= max(128, 0.02 * b) for a, b in taken.values())
    assert sum(a for a, _ in taken.values()) == pytest.approx(sum(r.size for r in once), rel=0.01)


def test_shards_make_no_difference_to_sums(documents):
    got = S.mix(documents, shard_words=200).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= max(256, 0.05 * r.g) for r in got)


@pytest.mark.parametrize(("total", "blocks"), [(1, 1), (10, 3), (997, 31), (1000, 40)])
def test_selected_blocks(spark, total, blocks):
    """Every word on its own, in plain Python: the blocks that the permutation puts first, and a part of the next."""
    edges = [-(-k * total // blocks) for k in range(blocks + 1)]
    df = spark.range(total).selectExpr("id AS at", "1L AS size")
    for seed in (0, 5, -17, 2**40 + 3):
        places = [(k * S._PRIMES[seed % len(S._PRIMES)] + seed % blocks) % blocks for k in range(blocks)]
        assert sorted(places) == list(range(blocks))
        for words in {0, total // 3, total * 4 // 5, total - 1}:
            full = words * blocks // total
            part = max(0, words - -(-full * total // blocks))
            want = [p for k in range(blocks) for p in range(edges[k], edges[k + 1]) if places[k] < full or (places[k] == full and p < edges[k] + part)]
            one = df.selectExpr("*", f"{words}L AS words", f"{total}L AS total", f"{blocks}L AS blocks", f"{seed}L AS seed")
            got = one.withColumn("n", S.selected("at", "size", "words", "total", "blocks", "seed")).where("n > 0").orderBy("at").collect()
            assert [r["at"] for r in got] == want
            assert abs(len(want) - words) <= blocks
            whole = one.selectExpr("0L AS at", f"{total}L AS size", "words", "total", "blocks", "seed").limit(1)
            assert whole.select(S.selected("at", "size", "words", "total", "blocks", "seed")).first()[0] == len(want)


def test_odd_rows(odd, empty):
    rows = S.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert S.mix(empty).count() == 0
    assert S.mixed(odd).columns == odd.columns
    assert S.mixed(empty).count() == 0
