"""Line dedup by a log-template tree of fixed depth (operator 8).

A line's leaf in the tree is its number of tokens and its leading tokens; runs of digits are variable
fields from the start. Inside a leaf, a line's constant tokens are those that most lines hold at their
positions: as few as make a share of SIMILARITY of its tokens, and all that equally many lines hold. The
others are variable fields, whatever the leaf's size. These constants are the line's template; a line of
which fewer tokens are held by `min_docs` lines each stands for itself. Where it is held by `min_docs` documents or more it is
boilerplate: its lines are dropped from all documents but the first that holds it (by doc_id), so that a
corpus of copies keeps one of each. So are lines of LONG_TOKENS tokens or more that LONG_DOCS documents hold
as they are, and lines of fewer than MIN_TOKENS tokens (as they are, but for blanks) that SHORT_DOCS hold.

How many documents are asked for grows with the corpus where a line is short: of `lines` lines of ordinary prose, about
lines / 2^(BITS_PER_TOKEN * tokens) equal one given line by chance, so that many are asked for at least. For lines of four tokens that is
over the constants above from some fifty million lines on, for lines of seven from 10^13 on; lines of one token have to stand in
1.6 % as many documents as there are lines, lines of two in 0.02 %. So prose of BITS_PER_TOKEN bits a token or more stays at any size of the corpus.

All of it is counting by key, combined before every shuffle; a leaf or a template, however frequent, is
never gathered. Tokens are only exploded for leaves with several distinct lines, once per distinct line.

Defined cases: a null text stays null and has no lines; lines without a token stay; lines
repeated inside one document count once; a null doc_id comes after all others; rows equal in doc_id and
text are one document here and get equal results; an empty table gives an empty result; further columns are
passed on (n_lines and n_dropped are
replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somaframe.llm._common import WORD, checkpoint, safely_named, salted_join

LEADING = 3
MIN_TOKENS = 4
MIN_DOCS = 3
#: A line of so many tokens or more that stands in LONG_DOCS documents character by character is a copy.
LONG_TOKENS, LONG_DOCS = 20, 2
#: A line of fewer than MIN_TOKENS tokens, digits and all, recurs if so many documents hold it.
SHORT_DOCS = 10
SIMILARITY = 0.6
#: Bits of information in a token of ordinary prose, low: what tells how often short lines recur by chance.
BITS_PER_TOKEN = 6
#: Leaves, or frequent tokens, that are sent to all executors (tens of bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Distinct lines whose texts are fetched by their places (some 60 bytes each, sent to all executors).
FETCH_ROWS = 250_000
#: Distinct lines of a leaf with a token at one place, beyond which the token counts as frequent there.
HOT_ROWS = 1000
_BLANKS = r"[\x20\x09-\x0D]+"


def _keyed(docs: DataFrame) -> DataFrame:
    """_nil (whether doc_id is null), _id and _text: a document's key, never null, ordered by doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    zero = F.lit(0).cast(kind)
    return docs.withColumns({"_nil": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", zero), "_text": F.xxhash64("text")})


KEY = ["_nil", "_id", "_text"]


def _tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, _BLANKS, " ")), " ")


def lines_of(docs: DataFrame) -> DataFrame:
    """KEY, line (from 0), short, n (tokens), leaf, exact (hash of the line with digits masked), same (hash of a long line as it is) and
    masked, for lines with tokens. A short line is its own leaf, digits and all."""
    each = docs.select(*KEY, F.posexplode(F.split("text", "\n")).alias("line", "raw")).where(F.col("raw").rlike(WORD[:-1]))
    # most lines have single blanks only, and need no rewriting; tokens are counted by the blanks between them
    each = each.withColumns({"plain": F.trim(F.when(F.col("raw").rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace("raw", _BLANKS, " ")).otherwise(F.col("raw"))), "masked": F.regexp_replace("raw", "[0-9]+", "0")})
    each = each.withColumn("n", F.octet_length("plain") - F.octet_length(F.replace("plain", F.lit(" "), F.lit(""))) + 1).withColumn("short", F.col("n") < MIN_TOKENS)
    spaced = F.regexp_replace(F.regexp_extract("masked", rf"^{_BLANKS[:-1]}*((?:{WORD}{_BLANKS}){{{LEADING - 1}}}{WORD})", 1), _BLANKS, " ")
    head = F.when(F.col("raw") == F.col("plain"), F.substring_index("masked", " ", LEADING)).otherwise(spaced)
    own = F.xxhash64("n", F.split("plain", " "))
    leaf = F.when(F.col("short"), own).otherwise(F.xxhash64("n", head))
    exact = F.when(F.col("short"), own).otherwise(F.xxhash64("masked"))
    same = F.when(F.col("n") >= LONG_TOKENS, F.xxhash64("raw", F.lit(1)))
    return each.select(*KEY, "line", "short", "n", leaf.alias("leaf"), exact.alias("exact"), same.alias("same"), "masked")


def texts_of(docs: DataFrame, lines: DataFrame, narrow: DataFrame, several: DataFrame) -> DataFrame:
    """leaf, exact, masked: the distinct lines of the leaves `several`.

    One line of each kind is enough, so its place is looked up in the lines already told apart, and only the texts that hold such
    places are split again. Where these are too many to be sent to all executors, all lines are told apart once more."""
    few = several.count() <= BROADCAST_ROWS
    held = narrow.join(F.broadcast(several), "leaf", "left_semi") if few else salted_join(narrow, several, ["leaf"], "left_semi", [*KEY, "line"])
    places = checkpoint(held.groupBy("leaf", "exact").agg(F.min(F.struct(*KEY, "line")).alias("at")).select("leaf", "exact", "at.*"))
    if places.count() <= FETCH_ROWS:
        asked = places.groupBy(*(F.col(c).alias(f"_of{c}") for c in KEY)).agg(F.collect_list(F.struct("line", "leaf", "exact")).alias("_places"))
        found = docs.select(*KEY, "text").join(F.broadcast(asked), [F.col(c) == F.col(f"_of{c}") for c in KEY])
        found = found.select(F.split("text", "\n").alias("_split"), F.explode("_places").alias("at"))
        # rows equal in doc_id and text give a line more than once
        return found.select("at.leaf", "at.exact", F.regexp_replace(F.element_at("_split", F.col("at.line") + 1), "[0-9]+", "0").alias("masked")).distinct()
    compared = lines.join(F.broadcast(several), "leaf", "left_semi") if few else salted_join(lines, several, ["leaf"], "left_semi", [*KEY, "line"])
    return compared.select("leaf", "exact", "masked").distinct()


def templates(texts: DataFrame, kinds: DataFrame, min_docs: int) -> DataFrame:
    """leaf, exact, template: for distinct lines of leaves that hold several; lines without enough constant tokens are missing.

    texts: as texts_of() gives them. kinds: leaf, exact and n (how many lines)."""
    texts = texts.withColumn("_tokens", _tokens(F.col("masked")))
    tokens = texts.join(kinds, ["leaf", "exact"]).select("leaf", "exact", "n", F.size("_tokens").alias("of"), F.posexplode("_tokens").alias("at", "token"))
    tokens = checkpoint(tokens.select("leaf", "exact", "n", "of", F.xxhash64("at", "token").alias("token")))
    common = checkpoint(tokens.groupBy("leaf", "token").agg(F.sum("n").alias("_n"), F.count("*").alias("_rows")).where(F.col("_n") >= min_docs))
    # a leaf's leading tokens stand in all of its lines: such tokens are sent to where the lines are
    hot = common.where(F.col("_rows") > HOT_ROWS).drop("_rows")
    if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        others = tokens.join(F.broadcast(hot), ["leaf", "token"], "left_anti").join(common.where(F.col("_rows") <= HOT_ROWS).drop("_rows"), ["leaf", "token"])
        held = tokens.join(F.broadcast(hot), ["leaf", "token"]).unionByName(others)
    else:
        held = salted_join(tokens, common.drop("_rows"), ["leaf", "token"], "inner", ["exact"])
    marked = held.groupBy("leaf", "exact").agg(F.first("of").alias("of"), F.sort_array(F.collect_list(F.struct("_n", "token")), asc=False).alias("_held"))
    least = F.ceil(F.col("of") * F.lit(SIMILARITY) - 1e-9).cast("int")
    bound = F.element_at("_held", least)["_n"]
    found = marked.where(F.size("_held") >= least).withColumn("_bound", bound)
    return found.select("leaf", "exact", F.xxhash64("leaf", F.transform(F.filter("_held", lambda t: t["_n"] >= F.col("_bound")), lambda t: t["token"])).alias("template"))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """KEY and _lines (array of line numbers that go). docs: with the columns of KEY."""
    lines = lines_of(docs)
    narrow = checkpoint(lines.drop("masked"))  # a row for each line with tokens
    kinds = checkpoint(narrow.groupBy("leaf", "exact").agg(F.count("*").alias("n")))
    chance = F.ceil(F.lit(float(narrow.count())) / F.pow(F.lit(2.0), BITS_PER_TOKEN * F.col("n"))).cast("int")
    enough = F.greatest(F.when(F.col("short"), max(min_docs, SHORT_DOCS)).otherwise(min_docs), chance)
    leaves = checkpoint(kinds.groupBy("leaf").agg(F.sum("n").alias("lines"), F.count("*").alias("kinds")).where(F.col("lines") >= min_docs))
    several = checkpoint(leaves.where("kinds > 1").select("leaf"))
    general = templates(texts_of(docs, lines, narrow, several), kinds, min_docs)
    held = salted_join(narrow, leaves.select("leaf"), ["leaf"], "left_semi", [*KEY, "line"])
    held = salted_join(held, general, ["leaf", "exact"], "left", [*KEY, "line"])
    held = held.select(*KEY, "line", F.coalesce("template", F.xxhash64("leaf", "exact")).alias("template"), enough.alias("enough"))
    long = narrow.where("same IS NOT NULL")
    twice = long.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same")
    copies = salted_join(long, twice, ["same"], "left_semi", [*KEY, "line"])
    held = checkpoint(held.unionByName(copies.select(*KEY, "line", F.col("same").alias("template"), F.lit(min(min_docs, LONG_DOCS)).alias("enough"))))
    first = F.min(F.struct(*KEY)).alias("first")
    recurring = held.select("template", "enough", *KEY).distinct().groupBy("template", "enough").agg(F.count("*").alias("docs"), first).where(F.col("docs") >= F.col("enough")).select("template", "enough", "first")
    gone = salted_join(held, recurring, ["template", "enough"], "inner", [*KEY, "line"]).where(F.struct(*KEY) != F.col("first"))
    return gone.groupBy(*KEY).agg(F.collect_set("line").alias("_lines"))


def drop_boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the text left after dropping, n_lines and n_dropped."""
    named, back = safely_named(docs, "doc_id", "text")
    keyed = _keyed(named)
    gone = dropped_lines(keyed, min_docs).select(*(F.col(c).alias(f"_of{c}") for c in KEY), "_lines")
    # split before the join, so that the lines are there as an array when some are taken out
    split = keyed.withColumn("_split", F.split("text", "\n")).drop("text")
    same = [split[c] == gone[f"_of{c}"] for c in KEY]
    found = split.join(gone, same, "left")
    last = F.size("_split") - 1
    kept = F.transform(F.array_except(F.sequence(F.lit(0), last), "_lines"), lambda i: F.element_at("_split", i + 1))
    counted = found.withColumns({
        "n_lines": F.when(F.col("_split").isNull(), 0).otherwise(F.size("_split")).cast("long"),
        "n_dropped": F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long"),
        "text": F.array_join(F.when(F.col("_lines").isNull(), F.col("_split")).otherwise(kept), "\n"),
    })
    return counted.select(*(b for b, c in zip(back, docs.columns, strict=True) if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")
