import pytest

from somaframe.llm import line_templates as S


@pytest.fixture
def pages(spark):
    rows = []
    for i in range(6):
        rows.append((i, f"Page {i} of the unique prose number word{i} here\nAll rights reserved by the owner of this site since 19{i}0\nUser alice{i}x logged in from host nine today"))
    rows.append((6, "A clean document with its own words\nand a second line that nobody else has"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_templates_go_from_all_but_the_first(pages):
    got = {r.doc_id: r for r in S.drop_boilerplate(pages).collect()}
    assert got[0].n_dropped == 0 and got[6].n_dropped == 0
    for i in range(1, 6):
        # the rights line differs by digits, the login line by a name: both are templates; so is the page line
        assert got[i].n_dropped == 3 and got[i].text == ""


@pytest.mark.parametrize("times", [1, 12])
def test_a_variable_field_whose_values_recur(spark, times):
    """Each author stands in `times` lines of the leaf, but no line recurs."""
    rows = [(a * 100 + c, f"Posted in category cat{'abcdefghijkl'[c]} by author{chr(97 + a % 26)}{chr(97 + a // 26)}") for a in range(60) for c in range(times)]
    got = S.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_dropped = 0").count() == 1


def test_fewer_documents_are_no_template(pages):
    assert S.drop_boilerplate(pages.where("doc_id < 2")).where("n_dropped > 0").count() == 0


def test_long_lines_in_two_documents_go(spark):
    line = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    df = spark.createDataFrame([(1, f"a b c d\n{line}"), (2, f"{line}\ne f g h"), (3, f"{line} 1"), (4, f"{line} 2")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in S.drop_boilerplate(df.where("doc_id < 3")).collect()} == {1: f"a b c d\n{line}", 2: "e f g h"}
    # these two differ in digits: not equal, and a template of two documents only
    assert S.drop_boilerplate(df.where("doc_id > 2")).where("n_dropped > 0").count() == 0


def test_short_lines_of_many_documents_go(spark):
    rows = [(i, f"Read more\nAll  rights reserved\n{i} of them" + ("\nrare" if i < 9 else "") + "\n\n") for i in range(12)]
    got = {r.doc_id: r for r in S.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_dropped == 0
    assert all(got[i].n_dropped == 2 and got[i].text == f"{i} of them" + ("\nrare" if i < 9 else "") + "\n\n" for i in range(1, 12))


def test_repeats_inside_one_document_stay(spark):
    df = spark.createDataFrame([(1, "one two three four\n" * 20)], "doc_id long, text string")
    assert S.drop_boilerplate(df).first().n_dropped == 0


def brute(rows, min_docs=S.MIN_DOCS):
    """Lines that go, by (doc_id, line), in plain Python: the tree's leaves, the constants of their lines, and the counts."""
    import math
    import re
    from collections import Counter, defaultdict

    blank = re.compile(r"[\x20\x09-\x0D]+")
    lines = []  # document, line, leaf, line as it is compared, long line
    for d, text in rows:
        for k, raw in enumerate((text or "").split("\n") if text is not None else []):
            tokens = [t for t in blank.split(raw) if t]
            if not tokens:
                continue
            masked = re.sub("[0-9]+", "0", raw)
            of = [t for t in blank.split(masked) if t]
            short = len(tokens) < S.MIN_TOKENS
            leaf = ("short", *tokens) if short else (len(tokens), *of[: S.LEADING])
            lines.append((d, k, leaf, tuple(tokens) if short else masked, raw if len(tokens) >= S.LONG_TOKENS else None))
    times = Counter((leaf, exact) for _, _, leaf, exact, _ in lines)
    leaf_lines, kinds = Counter(), defaultdict(set)
    for (leaf, exact), n in times.items():
        leaf_lines[leaf] += n
        kinds[leaf].add(exact)
    at = Counter()
    for leaf, some in kinds.items():
        if leaf[0] != "short" and len(some) > 1 and leaf_lines[leaf] >= min_docs:
            for exact in some:
                for i, t in enumerate(x for x in blank.split(exact) if x):
                    at[leaf, i, t] += times[leaf, exact]
    held = defaultdict(set)
    for d, k, leaf, exact, long in lines:
        if leaf_lines[leaf] >= min_docs:
            template = (leaf, exact)
            if leaf[0] != "short" and len(kinds[leaf]) > 1:
                tokens = [x for x in blank.split(exact) if x]
                n = sorted((at[leaf, i, t] for i, t in enumerate(tokens) if at[leaf, i, t] >= min_docs), reverse=True)
                least = math.ceil(len(tokens) * S.SIMILARITY - 1e-9)
                if len(n) >= least:
                    template = (leaf, tuple((i, t) for i, t in enumerate(tokens) if at[leaf, i, t] >= n[least - 1]))
            n = len(exact) if leaf[0] == "short" else leaf[0]
            held[template, max(max(min_docs, S.SHORT_DOCS) if leaf[0] == "short" else min_docs, math.ceil(len(lines) / 2 ** (S.BITS_PER_TOKEN * n)))].add((d, k))
        if long is not None:
            held["same", long, min(min_docs, S.LONG_DOCS)].add((d, k))
    gone = set()
    for key, where in held.items():
        docs = {d for d, _ in where}
        if len(docs) >= key[-1]:
            gone |= {(d, k) for d, k in where if d != min(docs)}
    return gone


def left(text, gone, d):
    return None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone)


@pytest.mark.parametrize("broadcast", [True, False])
def test_same_as_brute_force(documents, monkeypatch, broadcast):
    monkeypatch.setattr(S, "HOT_ROWS", 3)
    if not broadcast:
        monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(S, "FETCH_ROWS", 0)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    gone = brute(rows)
    got = {r.doc_id: r for r in S.drop_boilerplate(documents).collect()}
    assert gone and {d: got[d].text for d, _ in rows} == {d: left(t, gone, d) for d, t in rows}
    assert all(got[d].n_dropped == sum(x == d for x, _ in gone) for d, _ in rows)


def test_same_as_brute_force_on_made_up_logs(spark):
    import random

    rng = random.Random(8)
    words = ["job", "user", "node", "opened", "closed", "a1", "b22", "by", "at", "x", "y"]
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 4, 5, 6, 25])))
    common = [say() for _ in range(12)]
    vary = lambda line: " ".join(w if rng.random() < 0.85 else rng.choice(words) for w in line.split())
    rows = [(d, "\n".join(rng.choice(["", "  ", say(), rng.choice(common), vary(rng.choice(common)), "\t" + rng.choice(common) + " "]) for _ in range(rng.randrange(9)))) for d in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute(rows)
    assert len(gone) > 50
    assert {r.doc_id: r.text for r in S.drop_boilerplate(df).collect()} == {d: left(t, gone, d) for d, t in rows}


def test_very_many_lines_in_one_document(spark):
    rows = [(d, "\n".join(f"entry {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} of the list" for k in range(17_000))) for d in range(3)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in S.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (17_000, 0), 1: (17_000, 17_000), 2: (17_000, 17_000)}


def test_odd_rows(odd, empty):
    got = S.drop_boilerplate(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count()
    assert rows[6].n_dropped == 0 and rows[7].n_dropped == rows[8].n_dropped == 2
    assert rows[1].text == "" and rows[1].n_lines == 1
    assert S.drop_boilerplate(empty).count() == 0


def test_clean_prose_stays_at_any_size(spark, monkeypatch):
    """Words of 7.6 bits each: of 60,000 short lines of 30,000 documents under one in a thousand goes, and no more of them than of a
    sixth as many; with counts that do not grow with the corpus, many lines of one and two tokens would go."""
    from pyspark.sql import functions as F

    words = F.array(*(F.lit(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(194)))
    say = lambda seed: F.array_join(F.transform(F.sequence(F.lit(1), 1 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(6))), lambda k: F.element_at(words, (1 + F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(194))).cast("int"))), " ")
    share = {}
    for n in (5_000, 30_000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws("\n", say(1), say(2)).alias("text"))
        got = S.drop_boilerplate(docs).agg(F.sum("n_dropped").alias("gone"), F.sum("n_lines").alias("lines")).first()
        share[n] = got.gone / got.lines
    assert share[30_000] <= 0.001 and share[5_000] <= 0.001
    monkeypatch.setattr(S, "BITS_PER_TOKEN", 60)
    assert S.drop_boilerplate(docs).agg(F.sum("n_dropped")).first()[0] / got.lines > 0.1
