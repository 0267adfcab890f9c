import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from somaframe.llm import language_mixture as L
from somaframe.llm import quality_ftrl as Q
from somaframe.llm._common import text_bytes

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_on_held_out(spark, more):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.classify(more, labels).where("held_out").join(labels, "doc_id").toPandas()
    rank, good = got.score.rank(), got.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.999
    assert (got.predicted == got.quality).mean() > 0.97
    assert got.score.between(0, 1).all()


def plain_features(text):
    """Distinct buckets and the number of n-grams of one text: regular expressions, and the hash by its definition in whole numbers."""
    import re

    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 32
        x = x * 0x9E3779B97F4A7C15 & mask
        x ^= x >> 29
        x = x * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 32

    table, base = Q._ROLLING.words.tolist(), Q._ROLLING._base
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+", (text or "").encode())
    h = [mix((sum(table[b] * pow(base, i, 1 << 64) for i, b in enumerate(w)) + len(w)) & mask) for w in words]
    pairs = [mix((a * 3 + b) & mask) for a, b in zip(h, h[1:], strict=False)]
    triples = [mix((a * 3 + b) & mask) for a, b in zip(pairs, h[2:], strict=False)]
    every = h + pairs + triples
    return {g >> (64 - Q.BITS) for g in every}, len(every)


def test_quality_features_by_hand(documents):
    texts = ["Ab ab!! x", "", "go go", "go go go go", "...", "x\x00y é!日本 a-b", None] + [r.text for r in documents.where("length(text) < 2000").orderBy("doc_id").limit(30).collect()]
    bucket, first, total = Q.features(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        want, n = plain_features(t)
        assert set(bucket[first[i] : first[i + 1]].tolist()) == want and first[i + 1] - first[i] == len(want) and total[i] == n, t
    assert total[:4].tolist() == [4 + 3 + 2, 0, 3, 4 + 3 + 2] and len(set(bucket[first[3] : first[4]].tolist())) == 3
    w = np.random.default_rng(0).normal(size=1 << Q.BITS)
    alone = [Q.scores(*text_bytes(pa.array([t], pa.string())), w)[0] for t in texts]
    assert Q.scores(*text_bytes(pa.array(texts)), w).tolist() == pytest.approx(alone)
    assert alone[0] == pytest.approx(1 / (1 + np.exp(-sum(w[k] for k in plain_features(texts[0])[0]) / 3)))


def plain_leader(rows, passes):
    """Follow-the-regularised-leader updates, one coordinate after the other."""
    import math

    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= Q.L1:
            return 0.0
        return -(z[i] - math.copysign(Q.L1, z[i])) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)

    for _ in range(passes):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / Q.ALPHA
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_quality_same_as_plain_updates(spark, more):
    """One shard, so that the order of the updates is known: by the hash of doc_id."""
    import math

    docs = more.where("doc_id < 400").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 400")
    known = labels.where("crc32(CAST(doc_id AS STRING)) % 4 <> 2").join(docs, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(7))).collect()
    rows = []
    for r in known:
        buckets, n = plain_features(r.text)
        rows.append((dict.fromkeys(buckets, 1 / math.sqrt(max(1, n))), float(r.quality)))
    want = plain_leader(rows, Q.PASSES)
    got = Q.train(docs.unionByName(docs), labels)  # every doc_id twice: one row of each is learned from
    assert len(rows) > 100 and any(want.values())
    assert {i: w for i, w in enumerate(got.tolist()) if w} == pytest.approx({i: w for i, w in want.items() if w}, rel=1e-6)


def test_quality_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.classify(odd, none).collect()} == {0.5}
    some = spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 1, 1), (6, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.classify(odd, some).count() == odd.count()
    assert Q.classify(empty, some).count() == 0


def test_language_on_held_out(more):
    got = L.identify(more).where("held_out").join(more.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.99
    assert got.score.between(0, 1).all()


def test_mixtures(more):
    langs, model = L.train(more)
    pick = {r.lang: r.text for r in more.where(F.length("text") > 2000).groupBy("lang").agg(F.min("text").alias("text")).collect()}
    texts = [pick["de"][:1200], pick["de"][:900] + " " + pick["fr"][:600], ""]
    share, _ = L.infer(*L.trigrams(*text_bytes(pa.array(texts))), model)
    de, fr = langs.index("de"), langs.index("fr")
    assert share[0, de] == 1
    assert share[1, de] == pytest.approx(0.6, abs=0.1) and share[1, fr] == pytest.approx(0.4, abs=0.1)
    assert np.allclose(share.sum(axis=1), 1)


def test_many_languages(spark):
    """More languages than once were learned (256), each with words of its own; the last by code point are as good as the first."""
    rng = np.random.default_rng(5)
    words = [["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(12)] for _ in range(300)]
    rows = [(k * 10 + j, " ".join(words[k][i] for i in rng.integers(0, 12, 40)), f"l{k:03d}") for k in range(300) for j in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, _ = L.train(df)
    assert langs == [f"l{k:03d}" for k in range(300)]
    got = {r.doc_id: r.lang_pred for r in L.identify(df).collect()}
    assert all(got[d] == lang for d, _, lang in rows)


def test_blocks_of_languages_make_no_difference(more, monkeypatch):
    texts = text_bytes(pa.array([r.text for r in more.where("doc_id < 200").select("text").collect()]))
    whole = L.infer(*L.trigrams(*texts), L.train(more)[1])
    monkeypatch.setattr(L, "BLOCK", 3)
    _, model = L.train(more)
    assert len(model.blocks) > 1
    for a, b in zip(whole, L.infer(*L.trigrams(*texts), model), strict=True):
        assert np.allclose(a, b)


def test_clean_texts_in_many_languages_are_kept(spark):
    rng = np.random.default_rng(6)
    words = [["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(60)] for _ in range(6)]
    say = lambda k, n: " ".join(words[k][i] for i in rng.integers(0, 60, n))
    rows = [(k * 400 + j, say(k, 60), f"l{k}") for k in range(6) for j in range(400)]
    mixed = [(9000 + m, " ".join(say(k, 60) for k in range(m)), None) for m in range(2, 7)]
    junk = [(9900, " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(300)), None), (9901, "123 456", None)]
    df = spark.createDataFrame(rows + mixed + junk, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in L.keep_identified(df).where("doc_id >= 9000").collect()}
    assert kept == {d for d, _, _ in mixed}


def plain_mixture(text, langs, counts):
    """The same inference in plain Python: one trigram after the other, no counts, no arrays."""
    import math

    folded = [b | 32 if 65 <= b <= 90 or 97 <= b <= 122 else b if b > 127 else 32 for b in text.encode()]
    seen = []
    for i, b in enumerate(folded):
        if b != 32:
            before, after = folded[i - 1] if i else 32, folded[i + 1] if i + 1 < len(folded) else 32
            seen.append(((before << 16 | b << 8 | after) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - L.BITS))
    total = [sum(c.values()) + L.SMOOTHING * (1 << L.BITS) for c in counts]
    prob = [[(c.get(g, 0) + L.SMOOTHING) / t for g in seen] for c, t in zip(counts, total, strict=True)]
    fits = [sum(math.log(x) for x in p) for p in prob]
    fit = max(fits)
    who, share, price = [fits.index(fit)], [1.0], L.PENALTY * math.log(len(seen) + 1)
    while len(who) < len(langs):
        mixed = [sum(w * prob[k][t] for k, w in zip(who, share, strict=True)) for t in range(len(seen))]
        slope = {k: sum(prob[k][t] / mixed[t] for t in range(len(seen))) - len(seen) for k in range(len(langs)) if k not in who}
        k = max(slope, key=slope.get)
        if slope[k] <= price:
            break
        members, p = [*who, k], [w * 0.8 for w in share] + [0.2]
        for _ in range(L.STEPS):
            part = [0.0] * len(members)
            for t in range(len(seen)):
                each = [w * prob[m][t] for m, w in zip(members, p, strict=True)]
                part = [x + y / sum(each) for x, y in zip(part, each, strict=True)]
            p = [x / len(seen) for x in part]
        now = sum(math.log(sum(w * prob[m][t] for m, w in zip(members, p, strict=True))) for t in range(len(seen)))
        if now - fit <= price:
            break
        who, share, fit = members, p, now
    return {langs[k]: w for k, w in zip(who, share, strict=True) if w > 0}


def test_same_as_plain_inference(spark, more):
    langs, model = L.train(more)
    counts = [{} for _ in langs]
    lo = 0
    for width, cell, n in model.blocks:
        for c, x in zip(cell.tolist(), n.tolist(), strict=True):
            counts[lo + c % width][c // width] = x
        lo += width
    texts = [r.text for r in more.where("length(text) BETWEEN 20 AND 4000").orderBy(F.xxhash64("doc_id")).limit(40).collect()]
    texts += [texts[0] + " " + texts[1] + " " + texts[2], "x", "Ab 12 ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.detect(df, langs, model).collect()}
    for i, text in enumerate(texts):
        want = plain_mixture(text, langs, counts)
        assert dict(got[i].shares) == pytest.approx(want, abs=1e-6), text[:80]
        assert got[i].lang_pred == max(want, key=lambda k: (want[k], [-ord(c) for c in k]))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = ("Ein Wort und é noch eins. " * 50) + "zzz"
    whole = L.trigrams(*text_bytes(pa.array([text])))
    monkeypatch.setattr(L, "PIECE_BYTES", 37)
    for a, b in zip(whole, L.trigrams(*text_bytes(pa.array([text]))), strict=True):
        assert a.tolist() == b.tolist()


def test_language_odd(odd, empty):
    got = {(r.doc_id, r.lang_pred) for r in L.identify(odd).collect()}
    assert (4, "und") in got and (1, "und") in got and (None, "und") in got
    assert (3, "und") not in got
    assert L.identify(empty).count() == 0
    assert L.keep_identified(odd).columns == odd.columns
    assert {r.doc_id for r in L.keep_identified(odd).collect()} >= {3, 5, 6}
