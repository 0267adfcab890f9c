"""Embedding near-duplicates by counting collisions of one-dimensional projections (operator 10).

Vectors of one label are projected on DIRECTIONS random directions. For a pair as near as the threshold asks,
the difference along a random Gaussian direction is normal with the pair's distance as deviation, whatever
the vectors are. So the number of directions in which a pair falls into a window of given half width is
binomial with a known rate, and the count that all but MISSED of such pairs reach is exact arithmetic.
A pair that reaches it is verified by its cosine in double precision.

Each projection is sorted, and the window centred on a query is a range of that order. The vectors in it are the
difference of two prefixes of the order, held as bits; counts of 64 vectors are added at once, bit by bit.

To keep the search below all pairs, vectors of a label of more than CELL_ROWS are first dealt to cells: a cell is
told by the largest of some further projections and its sign, for one set of projections or several. Both ends
of a pair at the threshold are bivariate normal along a direction, so the rate at which they share a cell is known
too, and tables of cells are repeated until all but MISSED of such pairs share one. Each label gets the
cells and tables that its own size asks for. Cells that hold more than BLOCK_ROWS vectors are cut into blocks, and
each pair of blocks is a group of its own: no group outgrows a task. A pair is counted in the first table in
which it shares a cell, so no pair is ever emitted: groups return sums of links per vector, and spanning links.

Equal vectors are made one (with their number) before, and get equal results.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors with a
null label, link with nothing; vectors of different lengths never link; rows may repeat, each is a vector;
a null vec_id never is a component's id unless all members are null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somaframe.llm._common import checkpoint, ship, shuffle_partitions
from somaframe.llm._graph import components
from somaframe.llm.simhash_trie import forest

COSINE = 0.93
#: Directions whose collisions are counted, and half the width of a window in units of the distance at the threshold.
DIRECTIONS, HALF_WINDOW = 32, 3.0
#: Vectors that a cell should hold on average; vectors of a block (larger cells are cut).
CELL_ROWS, BLOCK_ROWS = 4096, 4096
#: Share of pairs at the threshold that the count, and the tables together, may miss.
MISSED = 1e-4
#: Projections of which the largest tells a cell, and sets of them in one table, among which the cheapest are chosen.
WIDTHS, SETS = (1, 2, 4, 8, 16, 32, 64, 128, 256), (1, 2, 3, 4)
#: Cells or labels of many vectors that are sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
SEED = 93
_ROWS, _PAIRS = 256, 50_000


def least_count(directions: int = DIRECTIONS, half_window: float = HALF_WINDOW, missed: float = MISSED) -> int:
    """The count of collisions that all but `missed` of the pairs at the threshold reach."""
    rate, below, k = math.erf(half_window / math.sqrt(2)), 0.0, 0
    while True:
        below += math.comb(directions, k) * rate**k * (1 - rate) ** (directions - k)
        if below > missed:
            return k
        k += 1


@lru_cache(maxsize=64)
def cell_rate(width: int, cosine: float = COSINE, draws: int = 40_000) -> float:
    """How often a pair with that cosine has the same largest of `width` projections, with the same sign."""
    rng = np.random.Generator(np.random.PCG64([SEED, width]))
    same = 0
    for k in range(0, draws, 4000):
        a = rng.standard_normal((min(4000, draws - k), width))
        b = cosine * a + math.sqrt(1 - cosine**2) * rng.standard_normal(a.shape)
        i, j, rows = np.abs(a).argmax(axis=1), np.abs(b).argmax(axis=1), np.arange(len(a))
        same += int(((i == j) & (a[rows, i] * b[rows, i] > 0)).sum())
    return same / draws


def grid(rows: int, cell_rows: int = CELL_ROWS, cosine: float = COSINE, missed: float = MISSED) -> tuple[int, int, int]:
    """Sets of projections in a table, projections in a set, and tables, for so many vectors of a label."""
    if rows <= cell_rows:
        return 0, 0, 1
    tables = lambda s, w: math.ceil(math.log(missed) / math.log(1 - cell_rate(w, cosine) ** s))
    enough = [(tables(s, w), s, w) for s in SETS for w in WIDTHS if (2 * w) ** s * cell_rows >= rows]
    found = min(enough) if enough else (tables(SETS[-1], WIDTHS[-1]), SETS[-1], WIDTHS[-1])
    return found[1], found[2], found[0]


@lru_cache(maxsize=8)
def _directions(n: int, length: int, salt: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, salt, length, n])).standard_normal((length, n))


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 0))


def cells(unit: np.ndarray, sets: int, width: int, tables: int) -> np.ndarray:
    """Cell number of each unit vector in each table."""
    out = np.zeros((len(unit), tables), np.int64)
    if not sets:
        return out
    for t in range(tables):
        for s in range(sets):
            line = unit @ _directions(width, unit.shape[1], 1 + t * sets + s)
            top = np.abs(line).argmax(axis=1)
            out[:, t] = out[:, t] * 2 * width + 2 * top + (line[np.arange(len(line)), top] < 0)
    return out


def misses(a: np.ndarray, b: np.ndarray, half: float, most: int) -> np.ndarray:
    """For each row of a, bits of those rows of b that are outside the window around a's value in `most` columns at most."""
    n = len(b)
    words = -(-n // 64)
    planes = [np.zeros((len(a), words), np.uint64) for _ in range(most.bit_length())]  # of the counts of misses
    more = np.zeros((len(a), words), np.uint64)  # the count went beyond what the planes hold
    where = np.arange(n)
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        line = b[order, j]
        prefix = np.zeros((n + 1, words), np.uint64)
        prefix[where + 1, order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
        np.cumsum(prefix, axis=0, out=prefix)  # distinct bits, so a sum is a union
        lo, hi = np.searchsorted(line, a[:, j] - half, "left"), np.searchsorted(line, a[:, j] + half, "right")
        carry = ~(prefix[hi] ^ prefix[lo])
        for plane in planes:
            both = plane & carry
            plane ^= carry
            carry = both
        more |= carry
    # counts above `most`: equal in the higher bits, larger in one where `most` has none
    above, equal = more, ~np.zeros_like(more)
    for k in range(len(planes) - 1, -1, -1):
        if most >> k & 1:
            equal &= planes[k]
        else:
            above = above | (equal & planes[k])
            equal &= ~planes[k]
    return ~above


def _rows(bits: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some rows that have bits, and these as a matrix of n columns."""
    some = np.flatnonzero(bits.any(axis=1))
    for k in range(0, len(some), _ROWS):
        rows = some[k : k + _ROWS]
        yield rows, np.unpackbits(bits[rows].view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def _verified(unit: np.ndarray, rows: np.ndarray, columns: np.ndarray, may: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs marked in `may` that have the cosine."""
    if 8 * np.count_nonzero(may) > may.size:  # most pairs of these rows: one product of matrices
        i, j = np.nonzero(may & (unit[rows] @ unit[columns].T >= cosine))
        return rows[i], columns[j]
    i, j = np.nonzero(may)
    i, j = rows[i], columns[j]
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), _PAIRS):
        keep[k : k + _PAIRS] = np.einsum("ij,ij->i", unit[i[k : k + _PAIRS]], unit[j[k : k + _PAIRS]]) >= cosine
    return i[keep], j[keep]


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (the lowest position that each reaches) with further pairs, by rows: each row's first pair before the others."""
    heads = np.flatnonzero(np.append(True, i[1:] != i[:-1])[: len(i)])
    for a, b in ((i[heads], j[heads]), (i, j)):
        apart = root[a] != root[b]
        if apart.any():
            a, b, own = a[apart], b[apart], np.arange(len(root))
            root = forest(len(root), np.concatenate([a, own]), np.concatenate([b, root]))
    return root


def _group(ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, table: int, shape: tuple[int, int], block: np.ndarray, large: bool, cosine: float) -> tuple[np.ndarray, ...]:
    """ids, sums of linked vectors and a spanning link, for the vectors of one or two blocks that have links here.

    large: the blocks are parts of a larger cell. Such a cell is often much the same in all tables; then pairs of
    vectors that share their most frequent earlier cell are left out at once."""
    half, most = HALF_WINDOW * math.sqrt(2 - 2 * cosine), DIRECTIONS - least_count()
    unit = _unit(vectors)
    lines = (unit @ _directions(DIRECTIONS, vectors.shape[1], 0)).astype(np.float32)
    total, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    own: np.ndarray | None = None
    before = np.zeros(len(ids), bool)  # these have shared a cell before
    if large and table:
        own = cells(unit, *shape, table)
        for t in range(table):
            kinds, n = np.unique(own[:, t], return_counts=True)
            if n.max() > before.sum():
                before = own[:, t] == kinds[n.argmax()]
    first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    same = block.min() == block.max()
    areas = [(first[~before[first]], second)] + ([] if same else [(first[before[first]], second[~before[second]])])
    for left, right in areas:
        if not (len(left) and len(right)):
            continue
        for rows, may in _rows(misses(lines[left], lines[right], half, most), len(right)):
            rows = left[rows]
            if same:
                may &= (rows[:, None] < right) | before[right]
            i, j = _verified(unit, rows, right, may, cosine)
            if table and len(i):  # pairs that share a cell of an earlier table were counted there
                if own is None:
                    own = cells(unit, *shape, table)
                keep = ~(own[i] == own[j]).any(axis=1)
                i, j = i[keep], j[keep]
            total += np.bincount(i, weights[j], len(ids)).astype(np.int64) + np.bincount(j, weights[i], len(ids)).astype(np.int64)
            root = _joined(root, i, j)
    some = np.flatnonzero(total)
    return ids[some], total[some], ids[root[some]]


def _sent(df: DataFrame) -> DataFrame:
    """df (written) with a hint to send it to all executors if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def links(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, n, root: sums of links and spanning links, from distinct vectors (id, m, vec, label)."""
    spark = vectors.sparkSession
    ship(spark)
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    sized = vectors.select("id", "m", "vec", "label", F.size("vec").alias("length"))
    # a label's size, doubled until it is reached: its vectors get the grid of that size
    large = sized.groupBy("label", "length").agg(F.count("*").alias("_n")).where(F.col("_n") > cell_rows)
    large = checkpoint(large.select("label", "length", F.ceil(F.log2(F.col("_n") / cell_rows)).cast("int").alias("level")))
    sized = sized.join(_sent(large), ["label", "length"], "left").select("id", "m", "vec", "label", F.coalesce("level", F.lit(0)).alias("level"))
    shape = lambda level: grid(cell_rows << level, cell_rows, cosine)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            levels = batch.column(4).to_numpy(zero_copy_only=False)
            for size, level in np.unique(np.stack([sizes, levels]), axis=1).T.tolist():
                part = batch.filter(pa.array((sizes == size) & (levels == level)))
                sets, width, tables = shape(level)
                own = cells(_unit(_matrix(part.column(2))), sets, width, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * tables, pa.int32()), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["id", "m", "vec", "label", "level", "cells"])

    dealt = sized.mapInArrow(deal, f"id long, m long, vec {kind['vec']}, label {kind['label']}, level int, cells array<long>")
    dealt = dealt.select("id", "m", "vec", "label", "level", F.size("vec").alias("length"), F.posexplode("cells").alias("table", "cell"))
    place = ["table", "label", "length", "cell"]
    cut = dealt.groupBy(*place).agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows)
    cut = checkpoint(cut.withColumn("blocks", F.ceil(F.col("_n") / block_rows)).drop("_n"))
    dealt = dealt.join(_sent(cut), place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "m", "vec", "level", *place, "block", (F.col("blocks") > 1).alias("large"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if rows.num_rows > 1:
                ids, weights, table, level, block = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4, 5))
                found = _group(ids, weights, _matrix(rows.column(2)), int(table[0]), shape(int(level[0]))[:2], block, rows.column(7)[0].as_py(), cosine)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "n", "root"])

        for batch in batches:
            key = batch.column(6).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                if a == b:
                    continue
                if held and key[a] != last:
                    yield from out()
                    held = []
                held.append(batch.slice(a, b - a))
                last = key[a]
        if held:
            yield from out()

    key = F.concat_ws("/", *(F.col(c).cast("string") for c in (*place, "low", "high")))
    dealt = dealt.withColumn("key", key).repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    return dealt.select("id", "m", "vec", "table", "level", "block", "key", "large").mapInArrow(run, "id long, n long, root long")


def near_duplicates(table: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row for each row of table (vec_id, embedding, label)."""
    rows = table.select("vec_id", "embedding", "label")
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    sound &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = rows.where("sound").withColumn("_h", F.xxhash64("embedding"))
    same = good.groupBy("label", "_h", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("m"))
    same = checkpoint(same.withColumn("id", F.monotonically_increasing_id()))  # numbers are fixed once written
    found = checkpoint(links(same.select("id", "m", F.col("embedding").alias("vec"), "label"), cosine, cell_rows, block_rows))
    sums = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classed = same.join(sums, "id", "left").join(parts, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    lowest = classed.groupBy("component").agg(F.min("first").alias("component_id"))
    classed = classed.join(lowest, "component").select(F.col("label").alias("_l"), F.col("_h").alias("_g"), F.col("embedding").alias("_e"), "component_id", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    linked = good.join(classed, (F.col("_h") == F.col("_g")) & (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
