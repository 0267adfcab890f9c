import re

import numpy as np
import pytest
import xxhash

from somaframe.llm import simhash_trie as S

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def roots(values, budget=2):
    """The lowest position that each reaches over pairs within the budget."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= budget):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_documents(documents):
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in S.classes(documents).collect()}
    fps = np.array([by_hand(r.text) for r in rows], np.uint64)
    assert [got[r.doc_id].fingerprint for r in rows] == [f"{int(f):016x}" for f in fps]
    assert [got[r.doc_id].component_id for r in rows] == [rows[k].doc_id for k in roots(fps)]


@pytest.mark.parametrize("node_rows", [4096, 4])
def test_links_connect_what_pairs_connect(spark, node_rows):
    rng, out = np.random.default_rng(0), []
    for base in rng.integers(0, 1 << 63, 60, dtype=np.uint64):
        for _ in range(20):
            v = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                v ^= 1 << int(k)
            out.append(v)
    values = np.unique(np.array(out, np.uint64))
    signed = values.view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    at = {int(v): i for i, v in enumerate(signed)}
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in S.links(df, node_rows=node_rows).collect():
        a, b = find(at[a]), find(at[b])
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(values))] == roots(values)


def test_descend_counts_all_pairs():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    a, b = S.descend(values, np.array([0]), 0)
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == want


def test_odd_rows(odd, empty):
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.fingerprint, r.component_id) for r in S.classes(odd).collect())
    assert len(got) == odd.count()
    assert {(d, c) for d, f, c in got if f == "0" * 16} == {(-1, 1), (1, 1), (2, 1)}
    assert {c for d, _, c in got if d in (6, 7, 8)} == {6}
    assert S.classes(empty).count() == 0
