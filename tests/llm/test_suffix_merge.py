import random
from collections import Counter

import pytest

from somaframe.llm import suffix_merge as S


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdé ") for _ in range(300)) for _ in range(6)]
    out = []
    for _ in range(120):
        t = rng.choice(base)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "X", "yy", rng.choice(base)[:60], "ab" * 30]) + t[k + rng.randrange(3) :]
        out.append(t)
    return [*out, "", "aaaa" * 50, None, "ab" * 100, "ab" * 100]


@pytest.mark.parametrize(("length", "gram", "buckets", "grams"), [(40, 8, 50, 10000), (40, 8, 50, 3), (400, 64, 20000, 20000), (25, 25, 100, 1000)])
def test_same_as_brute_force(spark, texts, length, gram, buckets, grams):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: bytes(r.kept) for r in S.dedup(df, length, gram, buckets, grams).collect()}
    want = brute([(t or "").encode() for t in texts], length)
    assert [got[i] for i in range(len(texts))] == want


def test_merge_is_a_sort_with_common_prefixes():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(500)]
    runs = [S.front_coded([(w, i) for i, w in enumerate(words) if i % 7 == k]) for k in range(7)]
    out = list(S.merged(runs))
    assert [t for t, _, _ in out] == sorted(words)
    assert [c for _, c, _ in out][1:] == [S.shared(a, b) for a, b in zip(sorted(words), sorted(words)[1:], strict=False)]
    assert list(S.merged([([], [], [])])) == []


def test_spans(spark):
    passage = "".join(random.Random(4).choice("abcdefgh") for _ in range(450))
    df = spark.createDataFrame([(1, f"one {passage} end"), (2, f"{passage}"), (3, f"zz{passage[:399]}")], "doc_id int, text string")
    got = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in S.dedup(df).collect()}
    assert got == {1: [(4, 454)], 2: [(0, 450)], 3: []}


def test_odd_rows(odd, empty):
    got = sorted((str(r.doc_id), r.n_bytes, bytes(r.kept)) for r in S.dedup(odd).collect())
    want = brute([(r.text or "").encode() for r in odd.collect()], 400)  # the very long text among them
    assert len(got) == odd.count()
    assert sorted(k for _, _, k in got) == sorted(want)
    assert S.dedup(empty).count() == 0
