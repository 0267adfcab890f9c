import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from somaframe.llm import fill_middle as M
from somaframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_example(doc_id, text, seed=42):
    """The example by a regular expression over the whole text."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def same(df, **kw):
    rows = M.examples(df, **kw).withColumn("restored", M.restore(F.col("output"), F.col("form"))).select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r[2:7] == plain_example(r.doc_id, r.text), r.doc_id
        assert r.restored == (r.text or "")
    return rows


def test_whole_table(documents):
    assert {r.form for r in same(documents)} == {"plain", "psm", "spm"}


@pytest.fixture(scope="module")
def awkward(spark):
    """Marks, halves of marks, blanks at both ends, characters of up to four bytes; each under forty ids, so that all forms come."""
    rng = np.random.default_rng(3)
    parts = ["<", "<P", "P>", "S>", "<<M", ">", " ", "\n", "\t ", "ä", "日本", "😀", "\x00", "word", "<Q>", " ", "<M "]
    texts = ["".join(rng.choice(parts, size)) for size in (1, 2, 3, 5, 8, 13, 40, 200, 700, 701)] + ["", " ", "x", "a <S> b", "<M>", " \n", "x ", " x", "<P" * 400 + ">", "ab " * 300, "y" * 900, " " * 900]
    rows = [(40 * i + k, t) for i, t in enumerate(texts) for k in range(40)] + [(None, None), (None, "a b c"), (5, texts[0]), (5, texts[0]), (7, texts[9]), (7, texts[9])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "form", "output", "_cut", "_key", "_whole", "first")})


def test_small_steps(awkward, monkeypatch):
    monkeypatch.setattr(M, "STEP", 7)
    monkeypatch.setattr(M, "SCAN_BYTES", 90)
    for t in awkward.select("text").distinct().toPandas().text:
        whole = pa.array([t, "a b", t, ""])
        got = M.cuts(whole, np.array([5, 5, 11, 3]), np.array([10, 10, 2, 1]))
        for i, (text, h1, h2) in enumerate(zip([t or "", "a b", t or "", ""], (5, 5, 11, 3), (10, 10, 2, 1), strict=True)):
            tokens = TOKEN.findall(text)
            a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
            assert (got["n"][i], got["first"][i], got["second"][i]) == (len(tokens), len("".join(tokens[:a])), len("".join(tokens[:b])))
            assert bool(got["marked"][i]) == any(m in text for m in ("<P>", "<S>", "<M>"))


@pytest.mark.parametrize("piece", [5, 64, 1 << 18])
def test_pieces_of_giants(awkward, piece):
    """From five bytes on all texts go through the distributed path; marks and tokens lie over the borders of pieces."""
    assert {r.form for r in same(awkward, piece=piece)} == {"plain", "psm", "spm"}


def test_composition_is_associative():
    rng = np.random.default_rng(1)
    data = np.frombuffer(bytes(rng.choice(np.frombuffer(b"<PSM> xy", np.uint8), 4000)), np.uint8)
    whole = M.piece_function(data)
    for cut in (1, 255, 256, 257, 1999):
        (s, e), (t, f) = M.piece_function(data[:cut]), M.piece_function(data[cut:])
        assert (t[s] == whole[0]).all() and (e + f[s] == whole[1]).all()


def test_odd(odd, empty):
    same(odd.drop("n_chars").withColumn("n", F.lit("x")))
    assert M.examples(odd).columns == [*(c for c in odd.columns if c not in ("n", "form", "output")), "n", "form", "prefix_chars", "middle_chars", "output"]
    assert M.examples(empty).count() == 0


def test_query_same_as_sql(spark):
    import duckdb

    got = QUERIES["op12_automaton_infill"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(ORACLES["op12_automaton_infill"]).df().sort_values("doc_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        assert (got[c].fillna(-1) == want[c].fillna(-1)).all(), c
