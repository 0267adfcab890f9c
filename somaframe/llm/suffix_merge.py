"""Suffix-array dedup by a common-prefix-aware distributed merge sort (operator 4).

A byte goes if it lies in a string of `length` bytes that also starts elsewhere. Sorting the suffix of every
byte is not needed to find those strings exactly:

1. Every window of `length` bytes is assigned to its anchor, the position of the lowest hash of GRAM bytes in
   it (the last of equals). Equal windows have their anchors at equal offsets, so only suffixes that start
   at anchors are sorted, about one in 190. The windows of an anchor start in one range, and span a segment.
2. Segments are counted by their hashes (128 bits with the anchor's gram). Windows of a segment that occurs
   twice all repeat. What remains are anchors whose gram occurs in several different segments.
3. Those suffixes are cut out of the texts, sorted into runs in the tasks that read them, and exchanged
   front-coded: of each suffix only what follows its common prefix with the one before.
4. A bucket's runs are merged by a loser tree that carries the common prefix of each head with the last
   suffix put out: two heads are compared only where their prefixes are equally long, from there on, so no
   known prefix is read again. The merge yields the suffix array with its common prefixes.
5. Along that array, suffixes are united in the order of falling common prefix. A set keeps its members sorted
   by their left contexts, read backwards; a member that joins is compared with its two neighbours. If two
   anchors share f bytes on the right and b on the left, windows that start d before them, for
   length - f <= d <= b, are equal; other members can add nothing to that.
6. Removed ranges are gathered per document and cut out of its bytes.

Buckets hold about BUCKET_ROWS distinct segments, however many copies there are. Where one gram has more than
GRAM_ROWS distinct segments (a passage's border in very many documents), their windows are compared by hash
instead, counted by key, so that no bucket has to hold such a gram.

Equality of whole segments, and of windows in that last case, is equality of 128 bits of hash; all else is compared byte
by byte.

Defined cases: a null text is empty; texts under `length` bytes keep all; repeated rows are documents of
their own, and so repeat each other; a null doc_id is a document like any other; an empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somaframe.llm._common import Rolling, checkpoint, chunks, mix64, salted_join, ship, text_bytes

LENGTH, GRAM = 400, 64
BUCKET_ROWS = 5_000
GRAM_ROWS = 5_000
#: Parts into which the anchors of a segment that occurs very often are dealt.
SALTS = 32
#: Suffixes of a run that one task sorts at once.
RUN_ROWS = 50_000
#: Windows looked at together; their positions fit into the low bits of a key.
PIECE, POSITION_BITS = 1 << 20, 21

_ROLLING = Rolling(4)
KEY = ["_nil", "_id", "_text"]


# --- anchors ---


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """text number, anchor, first and last window start, hash of the gram and of the segment; positions in data."""
    width = length - gram + 1
    sums = _ROLLING.sums(data)
    parts: list[tuple[np.ndarray, ...]] = []
    for base in range(0, max(0, len(data) - length + 1), PIECE):
        starts = np.arange(base, min(base + PIECE, len(data) - length + 1))
        grams = np.arange(base, starts[-1] + width)
        h = _ROLLING.ranges(sums, grams, grams + gram)
        # the low bits hold the position, the last one lowest, so the minimum is the last of the lowest hashes
        low = np.uint64((1 << POSITION_BITS) - 1)
        key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        blocks = np.concatenate([key, np.full(-len(key) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(starts)
        anchor = base + (low - (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low)).astype(np.int64)
        text = np.searchsorted(at, starts, "right") - 1
        inside = starts + length <= at[text + 1]
        starts, anchor, text = starts[inside], anchor[inside], text[inside]
        if not len(starts):
            continue
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
        last = np.append(first[1:], len(starts)) - 1
        p, lo, hi = anchor[first], starts[first], starts[last]
        parts.append((text[first], p, lo, hi, h[p - base], mix64(_ROLLING.ranges(sums, lo, hi + length) ^ np.uint64(1))))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# --- sorted runs and their merge ---


def shared(a: bytes, b: bytes, begin: int = 0) -> int:
    """Length of the common prefix, known to be `begin` at least."""
    n, at = min(len(a), len(b)), begin
    while at < n and a[at : at + 32] == b[at : at + 32]:
        at += 32
    if at >= n:
        return n
    x = int.from_bytes(a[at : min(n, at + 32)], "big") ^ int.from_bytes(b[at : min(n, at + 32)], "big")
    size = min(n, at + 32) - at
    return n if not x else at + size - (x.bit_length() + 7) // 8


def front_coded(run: list[tuple]) -> tuple[list[int], list[bytes], list[tuple]]:
    """A sorted run as common prefixes with the suffix before, what follows them, and the rest of each row."""
    run.sort(key=lambda r: r[0])
    before, common, rest = b"", [], []
    for row in run:
        k = shared(before, row[0])
        common.append(k)
        rest.append(row[0][k:])
        before = row[0]
    return common, rest, [r[1:] for r in run]


def merged(runs: list[tuple[list[int], list[bytes], list[tuple]]]) -> Iterator[tuple[bytes, int, tuple]]:
    """(suffix, common prefix with the one before, row) of all runs, in order, by a loser tree."""
    k = len(runs)
    at = [0] * k
    head: list[bytes | None] = [r[1][0] if r[0] else None for r in runs]
    known = [0] * k  # common prefix of each head with what was put out last
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes the one with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:  # the longer common prefix with the last output comes first
            return (a, b) if known[a] > known[b] else (b, a)
        n = shared(x, y, known[a])
        first = n == len(x) or (n < len(y) and x[n] < y[n])
        winner, loser = (a, b) if first else (b, a)
        known[loser] = n
        return winner, loser

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while head[winner] is not None:
        common, rest, rows = runs[winner]
        i, text = at[winner], head[winner]
        yield text, known[winner], rows[i]
        at[winner] = i + 1
        if i + 1 < len(common):
            known[winner] = common[i + 1]
            head[winner] = text[: common[i + 1]] + rest[i + 1]
        else:
            head[winner] = None
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeats(group: list[tuple[bytes, int, tuple[bytes, int, int]]], length: int) -> list[list[tuple[int, int]]]:
    """For each suffix of a part of the suffix array, ranges of d for which the window that starts d before it
    repeats. Rows: suffix, common prefix with the one before, (left context backwards, least and most d)."""
    found: list[list[tuple[int, int]]] = [[] for _ in group]

    def pair(x: int, y: int, f: int) -> None:
        b = shared(group[x][2][0], group[y][2][0])
        for e in (x, y):
            lo, hi = max(group[e][2][1], length - f), min(group[e][2][2], b)
            if lo <= hi and not any(a <= lo and hi <= z for a, z in found[e]):
                found[e].append((lo, hi))

    def unite(f: int) -> None:
        small, large = sorted((sets.pop(), sets.pop()), key=len)
        for item in small:
            k = bisect.bisect_left(large, item)
            if k:
                pair(item[1], large[k - 1][1], f)
            if k < len(large):
                pair(item[1], large[k][1], f)
            large.insert(k, item)
        sets.append(large)

    sets: list[list[tuple[bytes, int]]] = []
    borders: list[int] = []
    for i, (_, common, row) in enumerate(group):
        if i:
            while borders and borders[-1] > common:
                unite(borders.pop())
            borders.append(common)
        sets.append([(row[0], i)])
    while borders:
        unite(borders.pop())
    return found


# --- Spark stages ---


def _keyed(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").isNull().alias("_nil"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("_id"), F.xxhash64("text").alias("_text"), F.coalesce("text", F.lit("")).alias("text"))


def _anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """KEY, place (anchor << 20 | its distance from the first window << 10 | from the last), gram, segment."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                data, at = text_bytes(part.column(3))
                text, p, lo, hi, g, s = anchors(data, at, length, gram)
                rows = pa.array(text)
                place = (p - at[text]) << 20 | (p - lo) << 10 | (p - hi)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in range(3)), pa.array(place), pa.array(g.view(np.int64)), pa.array(s.view(np.int64))], names=[*KEY, "place", "gram", "segment"])

    return docs.mapInArrow(run, f"_nil boolean, _id {kind}, _text long, place long, gram long, segment long")


def _cut_out(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Each place's text on the right and, backwards, on the left; one row for a document's places."""
    listed = places.groupBy(*KEY).agg(F.collect_list(F.struct("place", "gram", "bucket", "copies")).alias("places"))
    return docs.join(listed.hint("shuffle_hash"), KEY).select(*KEY, "text", "places")


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """right, left, least and most d, place, gram, bucket, copies and key."""
    for batch in batches:
        for nil, key, text_hash, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            for x in places:
                p, most, least = x["place"] >> 20, x["place"] >> 10 & 1023, x["place"] & 1023
                yield raw[p : p - least + length], raw[p - most : p][::-1], least, most, x["place"], x["gram"], x["bucket"], x["copies"], (nil, key, text_hash)


def _by_merge(cut: DataFrame, length: int, gram: int) -> DataFrame:
    """KEY, begin, end: repeated ranges found along the suffix arrays of the buckets."""
    kind = cut.schema["_id"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def out() -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(9)]
            for bucket, rows in held.items():
                common, rest, other = front_coded(rows)
                for column, x in zip(columns, ([bucket], [common], [rest], *([list(c)] for c in zip(*other, strict=True))), strict=True):
                    column.extend(x)
            types = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(key_type), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "common", "rest", "left", "place", "copies", *KEY])

        n, key_type = 0, pa.int64()

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for batch in source:
                key_type = batch.column(1).type
                yield batch

        for right, left, _, _, place, _, bucket, copies, key in _contexts(typed(batches), length):
            held.setdefault(bucket, []).append((right, left, place, copies, *key))
            n += 1
            if n >= RUN_ROWS:
                yield out()
                held.clear()
                n = 0
        if held:
            yield out()

    run_rows = cut.mapInArrow(runs, f"bucket long, common array<int>, rest array<binary>, left array<binary>, place array<long>, copies array<long>, _nil array<boolean>, _id array<{kind}>, _text array<long>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, id_type = None, [], pa.int64()

        def out() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            group: list[tuple] = []

            def close() -> None:
                if len(group) > 1:
                    given = [(text, common, (row[0], row[1] & 1023, row[1] >> 10 & 1023)) for text, common, row in group]
                    for (_, _, row), ranges in zip(group, repeats(given, length), strict=True):
                        if row[2] == 1:  # of segments that occur more than once, all windows are known to repeat
                            p = row[1] >> 20
                            rows.extend((*row[3:6], p - hi, p - lo + length) for lo, hi in ranges)
                group.clear()

            for text, common, row in merged(held):
                if common < gram:
                    close()
                group.append((text, common, row))
            close()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), id_type, pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[*KEY, "begin", "end"])

        for batch in batches:
            id_type = batch.schema.field("_id").type.value_type
            for row in batch.to_pylist():
                if row["bucket"] != bucket and held:
                    yield from out()
                    held = []
                bucket = row["bucket"]
                held.append((row["common"], row["rest"], list(zip(*(row[c] for c in ("left", "place", "copies", *KEY)), strict=True))))
        if held:
            yield from out()

    return run_rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, f"_nil boolean, _id {kind}, _text long, begin long, end long")


def _by_window(cut: DataFrame, length: int) -> DataFrame:
    """KEY, begin, end: repeated windows found by their hashes (128 bits), for grams with very many segments."""
    kind = cut.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for right, left, least, most, place, gram, _, copies, key in _contexts(batches, length):
            data = np.frombuffer(left[::-1] + right, np.uint8)
            begin = np.arange(most - least + 1)
            h = _ROLLING.ranges(_ROLLING.sums(data), begin, begin + length).view(np.int64)
            n = len(h)
            columns = [[x] * n for x in key]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array((place >> 20) - most + begin), pa.array(np.full(n, gram, np.int64)), pa.array(h), pa.array(np.full(n, copies, np.int64))], names=[*KEY, "begin", "gram", "window", "copies"])

    windows = checkpoint(cut.mapInArrow(run, f"_nil boolean, _id {kind}, _text long, begin long, gram long, window long, copies long"))
    twice = windows.groupBy("gram", "window").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return windows.where("copies = 1").join(twice, ["gram", "window"], "left_semi").select(*KEY, "begin", (F.col("begin") + length).alias("end"))


def removed_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS, gram_rows: int = GRAM_ROWS) -> DataFrame:
    """KEY, ranges: array of (begin, end), not merged yet. docs: as _keyed() gives them."""
    found = checkpoint(_anchored(docs, length, gram))
    segments = found.groupBy("gram", "segment").agg(F.count("*").alias("copies"), F.min(F.struct(*KEY, "place")).alias("one"))
    grams = segments.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1").select("gram", "kinds")
    # a gram may have very many segments: they are dealt to parts, and the gram's one row is repeated for each
    open_ = salted_join(segments, grams, ["gram"], "inner", ["segment"]).select("gram", "kinds", "copies", "one.*")
    open_ = checkpoint(open_)
    buckets = max(1, -(-open_.count() // bucket_rows))
    places = open_.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    spans = _by_merge(_cut_out(docs, places.where(F.col("kinds") <= gram_rows), length), length, gram)
    if not open_.where(F.col("kinds") > gram_rows).isEmpty():
        spans = spans.unionByName(_by_window(_cut_out(docs, places.where(F.col("kinds") > gram_rows), length), length))
    # a segment may hold a third of all anchors: they are dealt to parts, and its one row is repeated for each
    twice = segments.where("copies > 1").select("gram", "segment", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("_salt"))
    found = found.withColumn("_salt", F.pmod(F.xxhash64(*KEY, "place"), F.lit(SALTS)))
    p = F.shiftright("place", 20)
    whole = found.join(twice, ["gram", "segment", "_salt"], "left_semi").select(*KEY, (p - F.shiftright("place", 10).bitwiseAND(1023)).alias("begin"), (p - F.col("place").bitwiseAND(1023) + length).alias("end"))
    return spans.unionByName(whole).groupBy(*KEY).agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS, gram_rows: int = GRAM_ROWS) -> DataFrame:
    """doc_id, n_bytes, spans (array of begin and end, maximal and in order) and kept (binary)."""
    if not 0 < gram <= length <= 1023:
        raise ValueError("0 < gram <= length <= 1023 is asked for")
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = _keyed(docs)
    ranges = removed_ranges(keyed, length, gram, bucket_rows, gram_rows)
    both = keyed.join(ranges.hint("shuffle_hash"), KEY, "left").select(F.when(~F.col("_nil"), F.col("_id")).alias("doc_id"), "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sizes, spans, kept = [], [], []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = text.encode()
                    runs: list[list[int]] = []
                    for begin, end in sorted((r["begin"], r["end"]) for r in ranges or ()):
                        if runs and begin <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], end)
                        else:
                            runs.append([begin, end])
                    cuts = [0, *(x for r in runs for x in r), len(raw)]
                    sizes.append(len(raw))
                    spans.append([{"begin": a, "end": b} for a, b in runs])
                    kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
