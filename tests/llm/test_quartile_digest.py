import hashlib

import numpy as np

from somaframe.llm import quartile_digest as S


def test_edited_texts(documents):
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in S.fingerprints(documents).collect()}
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        t, k = r.text or "", len(r.text or "") // 4
        edited = t[: len(t) - k] + (after.text or "")[:k]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, new, following = (S.digests([x.encode()]) for x in (t, edited, after.text or ""))
        assert (g.fingerprint, g.edited_fingerprint) == (S.text_of(own)[0], S.text_of(new)[0])
        assert (g.near_edited, g.near_next) == (S.likeness(own, new)[0], S.likeness(own, following)[0])
        assert 0 <= g.near_next <= 1


def test_counts_by_hand():
    for text in (b"", b"a", b"abcdefg", b"x" * 50):
        c = np.zeros(S.BUCKETS, int)
        data = text + b"\0\0\0\0"
        for i in range(len(text)):
            w = data[i : i + 5]
            for kind, (a, b, d) in enumerate(S.TRIPLETS):
                salt = (2, 3, 5, 7, 11, 13)[kind]
                h = S._PERMUTED[S._PERMUTED[S._PERMUTED[w[a]] ^ w[b] ^ salt] ^ w[d]]
                c[h & (S.BUCKETS - 1)] += 1
        assert (S.counts([text])[0] == c).all()


def test_near_beats_far(documents):
    got = S.fingerprints(documents).where("n_chars > 500").selectExpr("avg(near_edited) AS a", "avg(near_next) AS b").first()
    assert got.a > got.b + 0.05


def test_odd_rows(odd, empty):
    rows = S.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert len({r.fingerprint for r in rows if r.doc_id in (6, 7, 8)}) == 1
    assert S.fingerprints(empty).count() == 0
