"""Mixing sources to target weights by Sainte-Lague apportionment (operator 1), in DataFrame functions only.

1. Sources, in code point order with null last, get the weights in turn. Together they share all words;
   a source stops at `most` times its own size, and what it leaves is shared again by weight, until none
   is above (one pass over the sources in the order in which they reach that limit).
2. The budget is cut into blocks of equal numbers of words. Blocks go to sources by the highest
   quotients target / (2 k - 1). Only the O(sources) quotients near the cut are enumerated: shares bound
   how many blocks a source surely gets, and at most gets.
3. A source is dealt into shards by a seeded hash of its rows; its blocks go to groups of shards, and a group's blocks
   to its shards, the same way, claims being the shards' sizes, which gives each shard an integer quota.
4. The rows of a shard, in seeded order, are a line of words, cut into equal blocks. Whole rounds of a quota take
   each row that often; the rest selects blocks by their places in a seeded permutation.

The driver and single tasks only see one row for each source, for each group of a source, or for each shard of a group:
of a source's shards as many as the root of their number. The widest window orders narrow (id, size) rows of one shard.

Defined cases: a null or empty text has size 0 and is never taken; a source without words has target 0; a
null source is a source; rows equal in all columns are taken in either order; an empty table gives an
empty result. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somaframe.llm._common import WORD, checkpoint, safely_named

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 128
#: A source has one shard for each so many words.
SHARD_WORDS = 1 << 16
SEED = 20_011
#: Multipliers of permutations k -> (k * m + b) mod n: primes above any number of blocks in a shard.
_PRIMES = (1_000_000_007, 1_000_000_009, 998_244_353, 2_147_483_647)


def apportion(parties: DataFrame, group: list[str], party: str, claim: Column, seats: Column) -> DataFrame:
    """parties with `quota`: seats of each group dealt to its parties by the highest quotients claim / (2 k - 1).

    seats is the same for all rows of a group. Ties go to the lower party. Claims are not null; a party
    without a claim gets nothing."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    shares = (
        parties.withColumns({"_claim": claim.cast("double"), "_seats": seats.cast("double")})
        .withColumns({"_sum": F.sum("_claim").over(whole), "_n": F.count(F.when(F.col("_claim") > 0, 1)).over(whole)})
        .withColumn("_share", F.when(F.col("_claim") > 0, F.col("_seats") * F.col("_claim") / F.col("_sum")).otherwise(0.0))
    )
    # Rounding moves the divisor by at most a factor of 1 -+ n / (2 seats).
    slack = F.col("_n") / (2 * F.greatest(F.col("_seats"), F.lit(1.0)))
    shares = shares.withColumns({
        "_sure": F.greatest(F.lit(0), F.floor(F.col("_share") * (1 - slack) + 0.5) - 1).cast("long"),
        "_top": F.when(F.col("_claim") > 0, F.floor(F.col("_share") * (1 + slack) + 0.5) + 1).otherwise(0).cast("long"),
    })
    shares = shares.withColumn("_left", (F.col("_seats") - F.sum("_sure").over(whole)).cast("long"))
    tried = shares.where("_top > _sure").select(*group, party, "_claim", "_left", F.explode(F.sequence(F.col("_sure") + 1, "_top")).alias("_k"))
    order = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy((F.col("_claim") / (2 * F.col("_k") - 1)).desc(), F.col(party).asc_nulls_last(), "_k")
    won = tried.withColumn("_place", F.row_number().over(order)).where("_place <= _left").groupBy(*group, party).agg(F.count("*").alias("_won"))
    won = won.select(*(F.col(c).alias(f"_of_{c}") for c in (*group, party)), "_won")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, party)]
    return shares.join(won, same, "left").select(*parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, rank, target from (source, source_size): one row for each source."""
    one = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumns({
        "weight": F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")),
        "limit": F.col("source_size") * F.lit(float(most)),
    })
    order = one.orderBy((F.col("limit") / F.col("weight")).asc(), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(one) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return weighed.withColumn("_rate", rate).withColumn(
        # the first source that stays below its limit sets the rate of all that follow
        "_level", F.min(F.when(F.col("limit") > F.col("weight") * F.col("_rate"), F.struct(F.col("limit") / F.col("weight"), F.col("rank"), F.col("_rate").alias("rate")))).over(one)["rate"]
    ).select("source", "source_size", "rank", F.least("limit", F.coalesce(F.col("weight") * F.col("_level"), F.col("limit"))).alias("target"))


def selected(at: str, size: str, words: str, total: str, blocks: str, seed: str) -> Column:
    """Words that a row of `size` words, with `at` words before it, gives when `words` of a shard's `total` words are selected in
    `blocks` equal blocks: those that a seeded permutation puts first, and as much of the next one as is missing.

    All arguments name long columns; words <= total, blocks >= 1."""
    begin = lambda k: f"(({k} * {total} + {blocks} - 1) div {blocks})"  # noqa: E731  # place p is in block p * blocks div total
    whole = f"({words} * {blocks} div greatest({total}, 1))"
    rest = f"({words} - ({whole} * {total} + {blocks} - 1) div {blocks})"
    prime = f"element_at(array({', '.join(f'{p}L' for p in _PRIMES)}), cast(pmod({seed}, {len(_PRIMES)}) + 1 as int))"
    place = f"pmod(k * {prime} + pmod({seed}, {blocks}), {blocks})"
    end = f"CASE WHEN {place} < {whole} THEN {begin('(k + 1)')} WHEN {place} = {whole} THEN least({begin('k')} + greatest(0L, {rest}), {begin('(k + 1)')}) ELSE 0L END"
    given = f"greatest(0L, least({at} + {size}, {end}) - greatest({at}, {begin('k')}))"
    through = f"sequence({at} * {blocks} div {total}, ({at} + {size} - 1) * {blocks} div {total})"
    return F.expr(f"CASE WHEN {size} > 0 AND {words} > 0 THEN aggregate({through}, 0L, (sum, k) -> sum + {given}) ELSE 0L END")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and text_hash (xxhash64 of the text), one row for each document."""
    sized = checkpoint(docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy(F.lit(0)))
    block = F.greatest(F.lit(1.0), F.least(F.lit(float(block_words)), F.floor(least / 100)))
    sources = sources.withColumn("block", block)
    seats = F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / F.col("block"))
    sources = apportion(sources, [], "rank", F.col("target"), F.coalesce(seats, F.lit(0.0))).withColumn(
        "n_shards", F.greatest(F.lit(1), F.floor(F.col("source_size") / shard_words))
    ).withColumnRenamed("quota", "blocks").withColumn("n_groups", F.ceil(F.sqrt("n_shards")))
    sources = checkpoint(sources)  # a few rows, read twice

    # One row for each source: counted small before it is broadcast, else joined by shuffle.
    few = sources.count() <= 10_000
    side = sources.select(F.col("source").alias("_source"), "rank", "source_size", "target", "block", "blocks", "n_shards", "n_groups")
    rows = sized.join(F.broadcast(side) if few else side, sized["source"].eqNullSafe(side["_source"]), "inner").drop("_source")
    rows = rows.withColumn("shard", F.pmod("_h", F.col("n_shards")))

    one = (F.any_value(c).alias(c) for c in ("blocks", "block", "n_groups"))
    held = rows.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), *one).withColumn("group", F.pmod("shard", F.col("n_groups")))
    groups = held.groupBy("rank", "group").agg(F.sum("shard_size").alias("group_size"), F.any_value("blocks").alias("blocks"))
    groups = apportion(groups, ["rank"], "group", F.col("group_size"), F.col("blocks")).select("rank", "group", F.col("quota").alias("group_blocks"))
    quotas = apportion(held.join(groups, ["rank", "group"]), ["rank", "group"], "shard", F.col("shard_size"), F.col("group_blocks"))
    words = F.least(F.col("quota") * F.col("block"), F.col("shard_size") * F.lit(float(most))).cast("long")
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0)
    line = quotas.select(
        "rank", "shard", "shard_size", rounds.alias("_rounds"), (words - rounds * F.col("shard_size")).cast("long").alias("_rest"),
        F.greatest(F.lit(1), F.round(F.col("shard_size") / F.col("block"))).cast("long").alias("_blocks"),
        F.xxhash64(F.lit(seed + 1), "rank", "shard").alias("_seed"),
    )
    placed = rows.drop("blocks").join(line, ["rank", "shard"])
    order = Window.partitionBy("rank", "shard").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("_at", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long"))
    rest = selected("_at", "size", "_rest", "shard_size", "_blocks", "_seed")
    return at.select("doc_id", "source", "size", "source_size", "target", (F.col("_rounds") * F.col("size") + rest).cast("long").alias("taken"), "text_hash")


def mixed(docs: DataFrame, **how: int | tuple[int, ...]) -> DataFrame:
    """docs as the mix takes them: each document as often as it is taken, a partly taken one counting from half on.

    Rows equal in doc_id, source and text share what they are taken evenly, rounded."""
    taken = mix(docs, **how).groupBy("doc_id", "source", "text_hash").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("_times"))
    taken = taken.withColumn("_times", F.round("_times").cast("int")).where("_times > 0").select(*(F.col(c).alias(f"_of_{c}") for c in ("doc_id", "source", "text_hash")), "_times")
    named, back = safely_named(docs, "doc_id", "text", "source")
    keyed = named.withColumn("_text_hash", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(taken["_of_doc_id"]) & keyed["source"].eqNullSafe(taken["_of_source"]) & (keyed["_text_hash"] == taken["_of_text_hash"])
    return keyed.join(taken.hint("shuffle_hash"), same).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*back)
