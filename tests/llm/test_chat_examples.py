import random

import duckdb
from pyspark.sql import functions as F

from somaframe.llm import chat_examples as S
from somaframe.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(queries.ORACLES["op9_prefix_targets"]).df()
    got = queries.op9_prefix_targets(spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).to_numpy())) == sorted(map(tuple, want.astype(str).to_numpy()))


def test_escapes_are_reversible(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["\\", "<", "|", "<|", "|>", "\n", "a", "<|im_end|>", "\\n"]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", S.unescape(S.escape(F.col("t"))).alias("a"), S.unescape_role(S.escape_role(F.col("t"))).alias("b"), S.escape(F.col("t")).alias("e"), S.escape_role(F.col("t")).alias("r")).collect()
    for r in rows:
        assert r.a == r.b == r.t
        assert "<|" not in r.e and "<|" not in r.r and "\n" not in r.r


def test_prefixes_and_masks(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1 <|im_end|>"), (1, 3, "user", "q2"), (1, 4, "assistant", "a2"), (1, 5, "user", "bye"), (2, 0, "user", "alone")]
    rows = S.examples(spark.createDataFrame(turns, SCHEMA)).orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.n_turns, r.last) for r in rows] == [(1, 3, False), (1, 5, False), (1, 6, True), (2, 1, True)]
    under = [r.formatted[r.loss_begin : r.loss_begin + r.loss_length] if r.loss_begin is not None else None for r in rows]
    assert under == ["a1 <\\|im_end|>", "a2", None, None]
    assert rows[1].formatted.startswith(rows[0].formatted)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", None), (5, 1, "assistant", ""), (5, 1, "assistant", ""), (5, 1, "us\ner", "x"), (6, 0, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS parts", "2 AS target", "3 AS formatted")
    got = {r.conv_id: r for r in S.digests(S.examples(df)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {None: (2, 0), 5: (3, 0), 6: (1, 200_000)}
    assert S.digests(S.examples(df.limit(0))).count() == 0
