"""SimHash near-duplicates by a self-join of binary tries (operator 7).

Fingerprints come from hashed word shingles: a bit is set where more than half of the hashes set it.
Equal fingerprints are first made one. The join descends a binary trie of fingerprints with pairs of
nodes, adding up the bits in which they differ, and drops a pair when it has more than the error budget.

To spread the join, fingerprints are dealt to three tries, whose bits begin with another third each: a
pair within two bits agrees on one third, so in that trie the descent may begin at each node of that
depth paired with itself. Nodes there that hold many fingerprints are divided once more by thirds of the
remaining bits, by the same argument. A node's links are joined into a spanning forest in place, so no
task returns more links than it has fingerprints.

Defined cases: null texts are empty; a text without words has fingerprint zero, linked like any other; a
text with fewer words than a shingle has one shingle; a null doc_id never is a component's id (unless
all its members are null); repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somaframe.llm._common import checkpoint, chunks, ship
from somaframe.llm._graph import components

SHINGLE, SEED, BUDGET = 3, 42, 2
BITS = 64
#: Fingerprints under one node of a trie that a task joins without dividing them again.
NODE_ROWS = 4096
#: Fingerprints of several nodes that a task joins at once.
SLICE_ROWS = 8192

_LANES = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    n, h = len(words), xxhash.xxh64_intdigest
    if n <= size:
        return [h(b" ".join(words), SEED)] if n else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    return [h(joined[b:e], SEED) for b, e in zip(begins[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each consecutive run of hashes; of an empty run, zero."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    starts = np.cumsum(sizes) - sizes
    parts = -(-sizes // 255)  # a lane of eight bits holds sums of 255 rows
    owner = np.repeat(np.arange(len(sizes)), parts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts, first = starts[owner] + 255 * within, np.cumsum(parts) - parts
    data = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[data[:, byte]], cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")[:, 0]
        out[full] |= bits.astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Columns `keys` and fingerprint (long, the 64 bits)."""
    ship(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                lists = [shingle_hashes(t.encode() if t else b"", size) for t in part.column(len(keys)).to_pylist()]
                found = majority(np.array([h for x in lists for h in x], np.uint64), np.array([len(x) for x in lists], np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keys))), pa.array(found.view(np.int64))], names=[*keys, "fingerprint"])

    return docs.select(*keys, text).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "fingerprint long"]))


def _thirds(begin: int, end: int) -> list[tuple[int, int]]:
    at = [begin + round((end - begin) * k / 3) for k in range(4)]
    return list(zip(at, at[1:], strict=False))


Tries = tuple[list[tuple[list[int], int]], list[tuple[list[int], int]]]


def orders(fixed: int = 0) -> Tries:
    """Orders of the 64 bits (from the highest) and how many of them agree: three tries, and three for each of them.
    Pairs always agree in the first `fixed` bits (the number of a table)."""
    first, second, front = [], [], list(range(fixed))
    for lo, hi in _thirds(fixed, BITS):
        head, rest = front + list(range(lo, hi)), [b for b in range(fixed, BITS) if not lo <= b < hi]
        first.append((head + rest, len(head)))
        for a, b in _thirds(0, len(rest)):
            second.append((head + rest[a:b] + rest[:a] + rest[b:], len(head) + b - a))
    return first, second


WHOLE = orders()


def reorder(values: np.ndarray, order: list[int]) -> np.ndarray:
    """Bit order[k] (0: the highest) of each value becomes bit k."""
    out, k = np.zeros(len(values), np.uint64), 0
    while k < BITS:
        run = k
        while run + 1 < BITS and order[run + 1] == order[run] + 1:
            run += 1
        n = run - k + 1
        piece = values >> np.uint64(BITS - 1 - order[run])
        if n < BITS:
            piece &= np.uint64((1 << n) - 1)
        out |= piece << np.uint64(BITS - 1 - run)
        k = run + 1
    return out


def descend(values: np.ndarray, starts: np.ndarray, agreed: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that differ in at most `budget` bits, within the runs of `values` that begin at `starts`.

    Values are sorted and distinct within a run, and agree there in their first `agreed` bits. All pairs of
    nodes of one depth are held as arrays: ranges of the two nodes, and the bits in which they differ so far."""
    ends = np.append(starts[1:], len(values))
    keep = ends - starts > 1
    a0 = b0 = starts[keep]
    a1 = b1 = ends[keep]
    d = np.zeros(len(a0), np.int8)
    for bit in range(BITS - 1 - agreed, -1, -1):
        if not len(d):
            break
        zeros = np.concatenate([[0], np.cumsum((values >> np.uint64(bit) & np.uint64(1)) == 0)])
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        cross = a0 != b0
        parts = [
            (a0, am, b0, bm, d),
            (am, a1, bm, b1, d),
            (a0, am, bm, b1, d + 1),
            (am[cross], a1[cross], b0[cross], bm[cross], d[cross] + 1),
        ]
        a0, a1, b0, b1, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (a1 > a0) & (b1 > b0) & (d <= budget) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, d = (x[keep] for x in (a0, a1, b0, b1, d))
    return a0, b0


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest position that each position reaches over the pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def _dealt(fps: DataFrame, tries: list[tuple[list[int], int]], which: str | None = None) -> DataFrame:
    """fp, trie, value (reordered), node (its agreed bits). which: a column with the first trie; only the tries under it."""
    ship(fps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            first = batch.column(1).to_numpy(zero_copy_only=False) if which else None
            for t, (order, agreed) in enumerate(tries):
                own = fp if first is None else fp[first == t // 3]
                value = reorder(own.view(np.uint64), order)
                node = value >> np.uint64(BITS - agreed)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), t, np.int32)), pa.array(value.view(np.int64)), pa.array(node.view(np.int64))], names=["fp", "trie", "value", "node"])

    return fps.select("fp", *([which] if which else [])).mapInArrow(run, "fp long, trie int, value long, node long")


def _joined(dealt: DataFrame, tries: list[tuple[list[int], int]], budget: int) -> DataFrame:
    """a, b: spanning links of the pairs under each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(fp: np.ndarray, trie: np.ndarray, value: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.flatnonzero((trie[1:] != trie[:-1]) | (node[1:] != node[:-1])) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.append(starts, len(fp)))
            many = np.repeat(sizes > 1, sizes)  # a fingerprint alone under its node has no partner
            fp, trie, value, node = fp[many], trie[many], value[many], node[many]
            sizes = sizes[sizes > 1]
            starts = np.cumsum(sizes) - sizes
            i = 0
            while i < len(starts):
                j = i + 1
                while j < len(starts) and trie[starts[j]] == trie[starts[i]] and starts[j] + sizes[j] - starts[i] <= SLICE_ROWS:
                    j += 1
                lo, hi = starts[i], starts[j - 1] + sizes[j - 1]
                a, b = descend(value[lo:hi].view(np.uint64), starts[i:j] - lo, tries[trie[lo]][1], budget)
                root = forest(hi - lo, a, b)
                # each to its lowest partner, a pair of the join; the lowest of a neighbourhood to the tree's root
                to = np.arange(hi - lo)
                np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
                own = np.flatnonzero(root != np.arange(hi - lo))
                to[own] = np.where(to[own] == own, root[own], to[own])
                if len(own):
                    part = fp[lo:hi]
                    yield pa.RecordBatch.from_arrays([pa.array(part[own]), pa.array(part[to[own]])], names=["a", "b"])
                i = j

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]))
            if sum(x.shape[1] for x in held) > 16 * SLICE_ROWS:
                rows = np.concatenate(held, axis=1)
                border = np.flatnonzero((rows[1, 1:] != rows[1, :-1]) | (rows[3, 1:] != rows[3, :-1]))
                cut = int(border[-1]) + 1 if len(border) else 0  # the last node may go on
                if cut:
                    yield from out(*rows[:, :cut])
                held = [rows[:, cut:]]
        if held:
            rows = np.concatenate(held, axis=1)
            if rows.shape[1]:
                yield from out(*rows)

    unsigned = F.col("value").bitwiseXOR(F.lit(-(1 << 63)))
    return dealt.repartition("trie", "node").sortWithinPartitions("trie", "node", unsigned).mapInArrow(run, "a long, b long")


def links(fps: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS, tries: Tries | None = None) -> DataFrame:
    """a, b: links that connect exactly what pairs of fingerprints within `budget` (at most 2) bits connect.

    fps: distinct fingerprints in column fp."""
    if not 0 <= budget <= 2:
        raise ValueError("a budget of at most two bits is supported")
    first, second = tries or WHOLE
    dealt = _dealt(fps, first)
    large = dealt.groupBy("trie", "node").agg(F.count("*").alias("n")).where(F.col("n") > node_rows).select("trie", "node")
    large = checkpoint(large)
    if large.isEmpty():
        return _joined(dealt, first, budget)
    small = dealt.join(large, ["trie", "node"], "left_anti").select("fp", "trie", "value", "node")
    divided = dealt.join(large, ["trie", "node"], "left_semi").select("fp", "trie")
    return _joined(small, first, budget).unionByName(_joined(_dealt(divided, second, "trie"), second, budget))


def classes(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """keys, fingerprint (hex), component_id (the lowest doc_id that links reach)."""
    marked = checkpoint(fingerprints(docs, keys, size=size))
    firsts = checkpoint(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")))
    found = components(links(firsts, budget))
    classed = firsts.join(found, firsts["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = classed.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = classed.join(lowest, "component").select("fp", "component_id")
    return marked.join(ids, marked["fingerprint"] == ids["fp"]).select(*keys, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
