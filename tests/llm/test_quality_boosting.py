import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from somaframe.llm import quality_boosting as B
from somaframe.llm._common import Rolling, text_bytes
from somaframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    """One text, by plain Python."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_distinct": len(set(words)), "n_twins": sum(a == b for a, b in zip(words, words[1:], strict=False)),
        "n_upper": sum("A" <= c <= "Z" for c in text), "n_letters": sum(c.isascii() and c.isalpha() for c in text), "n_digits": sum("0" <= c <= "9" for c in text), "n_points": sum(c in ".,;:!?" for c in text),
    }


AWKWARD = [
    "", " ", "\n", "\n\n a", "x", "a b c d e f g h", "a " * 9, "a b c d e f g h a b c d e f g h", "line one\nline one\nline one \n\n\nline one", "a\x00b ä\t日本語 😀😀\r\nX",
    "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3 + "w1 w2", "#tag | <b> $5 100% & *", "the the\nthe the\n the the", "no newline at end\n", "a b c d e f g h x a b c d e f g h y a b c d e f g h",
]


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_counts_by_hand(documents, monkeypatch, block):
    """All texts at once, so that words, lines and windows of neighbours could touch; and in blocks of seven bytes."""
    monkeypatch.setattr(B, "CHUNK_BYTES", block)
    texts = AWKWARD + [r.text for r in documents.where("length(text) < 3000").orderBy("doc_id").limit(60 if block > 100 else 8).collect()] + ["end", ""]
    got = B.counted(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert {name: int(got[name][i]) for name in B.COUNTS} == plain_counts(t), repr(t[:60])


def test_hashes_in_blocks():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 400).astype(np.uint8)
    cuts = np.unique(rng.integers(0, 401, 60))
    begin, end = cuts[:-1], cuts[1:]
    r = Rolling(3)
    want = r.ranges(r.sums(data), begin, end)
    for block in (1, 7, 64, 1000):
        assert (r.hashes(data, begin, end, block) == want).all()


def test_query_counts_and_verdict_on_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op11_boosted_rules"](spark, SF).toPandas()
    assert len(got) == docs.count()
    assert (got.base_failed == ((got.n_words < 20) | (100 * got.n_repeat_words > 30 * got.n_words))).all()
    assert not (got.kept & got.base_failed).any()
    some = docs.where("doc_id % 40 = 3 AND length(text) < 6000").toPandas()
    by = got.set_index("doc_id")
    for doc_id, text in zip(some.doc_id, some.text, strict=True):
        want = plain_counts(text)
        assert all(by.loc[doc_id, c] == want[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), doc_id
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    good, judged = held.quality == 1, ~held.base_failed
    assert held.kept[good & judged].mean() > 0.99
    assert not held.kept[~good].mean() > 0.02


def test_scores_never_rise_with_a_constrained_feature(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").withColumn("quality", F.when(F.rand(3) < 0.3, 1 - F.col("quality")).otherwise(F.col("quality")))
    model = B.train(docs, labels)  # noisy labels, so that free trees would bend
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(300, len(B.FEATURES)))) * np.array([8, 6, 1, 1, 1, 0.5, 1, 1, 1, 1, 3])
    for f, sign in enumerate(B._SIGNS):
        if sign:
            grid = np.stack([np.where(np.arange(x.shape[1]) == f, v, x) for v in np.linspace(0, 2, 40)])
            found = np.stack([model.logits(g) for g in grid])
            assert (np.diff(found, axis=0) <= 1e-12).all()
    assert len(np.unique(model.feature[np.isfinite(model.threshold)])) > 3


def test_flat_trees_same_as_walked_ones():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, len(B.FEATURES))) ** 2
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7)).astype(float)
    model = B.boost(x, y, trees=20)

    def walk(row):
        total = model.start
        for t in range(len(model.value)):
            node = 0
            while node < len(model.threshold[t]):
                node = 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1)
            total += model.value[t, node - len(model.threshold[t])]
        return total

    assert model.logits(x[:80]) == pytest.approx([walk(r) for r in x[:80]])
    assert ((model.scores(x) >= 0.5) == (y == 1)).mean() > 0.95


def test_first_split_same_as_all_cuts_tried():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(200, len(B.FEATURES))) ** 2, 1)
    y = (x[:, 2] + rng.normal(size=200) * 0.3 < 0.9).astype(float)
    model = B.boost(x, y, trees=1)
    p = 1 / (1 + np.exp(-model.start))
    best = (-np.inf, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f]):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < B.LEAST_ROWS:
                continue
            value = [(y[s] - p).sum() / (s.sum() * p * (1 - p) + B.PENALTY) for s in (left, ~left)]
            gain = sum((y[s] - p).sum() * v / 2 for s, v in zip((left, ~left), value, strict=True))
            if B._SIGNS[f] * (value[1] - value[0]) >= 0 and gain > best[0] + 1e-12:
                best = (gain, (f, cut))
    assert (model.feature[0, 0], model.threshold[0, 0]) == best[1]


def test_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = B.train(odd, none)
    got = B.rated(odd, model)
    assert got.columns[-len(B.COUNTS) - 3 :] == [*B.COUNTS, "score", "base_failed", "kept"] and set(odd.columns) <= set(got.columns)
    rows = got.collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == odd.count()
    for r in rows:
        if r.doc_id != 5:
            assert {c: r[c] for c in B.COUNTS} == plain_counts(r.text)
    assert all(r.kept == (not r.base_failed) for r in rows)
    some = spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 1, 1), (6, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert B.rated(odd, B.train(odd, some)).count() == odd.count()
    assert B.rated(empty, B.train(empty, some)).count() == 0
