"""SentencePiece encoding and decoding that keeps the byte span of every piece (operator 2).

A text is normalised by the longest prefixes of the model's compiled character map, and the source
offset of every normalised byte is recorded on the way; pieces are then merged by score inside the
stretches that no piece of the vocabulary can cross, and every piece is projected through the recorded
offsets to a byte span of the original text.

Defined cases: a null text is an empty one; an empty text has only the begin and end ids; rows may
repeat; an empty table gives an empty result; columns of the input that are not asked for are dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from somaframe.llm._common import chunks, ship

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the format
SPACE = "▁"  # the mark that stands for a blank
#: Entries that a worker's cache of merged words holds before it starts anew.
CACHE_WORDS = 200_000


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: number, and integer or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes, whose values point at replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.strings = blob[4 + size :]
        self.first = self._firsts()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _firsts(self) -> frozenset[int]:
        """Bytes that begin some entry."""
        if not self.units:
            return frozenset()
        root = self._offset(self.units[0])
        return frozenset(b for b in range(1, 256) if (root ^ b) < len(self.units) and (self.units[root ^ b] & 0x800000FF) == b)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that begins at `at`, and its replacement."""
        if not self.units or text[at] not in self.first:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(text)):
            if not text[i]:
                break
            node ^= text[i]
            unit = self.units[node]
            if (unit & 0x800000FF) != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class Codec:
    """A BPE model file, read for encoding, decoding and spans."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        charmap, self.prefix, self.trim, self.escape, kind = b"", True, True, True, 1
        for number, value in fields(model):
            if number == 1:
                piece, score, type_ = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        type_ = v
                self.pieces.append((piece, score, type_))
            elif number == 2:
                kind = next((v for n, v in fields(value) if n == 3), 1)
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        charmap = v
                    elif n == 3:
                        self.prefix = bool(v)
                    elif n == 4:
                        self.trim = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        if kind != 2 or any(t in (USER, UNUSED) for _, _, t in self.pieces) or not self.escape:
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        self.charmap = CharMap(charmap)
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bos = next(i for i, p in enumerate(self.pieces) if p[0] == "<s>")
        self.eos = next(i for i, p in enumerate(self.pieces) if p[0] == "</s>")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.scores = {p: s for p, s, t in self.pieces if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("only models with byte fallback are supported")
        # Pieces may not cross a blank mark from the left, nor touch a line feed: words can be merged one by one.
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("pieces of this model cross word borders")
        surface = [b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in self.pieces]
        self.surface_bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.concatenate([[0], np.cumsum(self.surface_len)[:-1]])
        norm = [b"" if t in (CONTROL, UNKNOWN) else bytes(1) if t == BYTE else p.encode() for p, _, t in self.pieces]
        self.norm_len = np.array([len(s) for s in norm], np.int64)
        self.head, self.tail = Words(self, ""), Words(self, SPACE)
        self.pair_keys, self.pair_ids, self.pair_ranks = self._pairs()

    # --- normalisation ---

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and for each of its bytes and its end the source byte (None: the identity
        map with a blank in front, where only a blank's mark is longer than its source)."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.charmap.units and not self.trim:
            out = text.replace(" ", SPACE)
            return (SPACE + out if self.prefix else out), None
        raw, out, source, at = text.encode(), bytearray(), [], 0
        mark = SPACE.encode()

        def put(piece: bytes, where: int) -> None:
            for i, part in enumerate(piece.split(b" ")):
                if i:
                    out.extend(mark)
                    source.extend([where] * 3)
                out.extend(part)
                source.extend([where] * len(part))

        steps = []
        while at < len(raw):
            hit = self.charmap.longest(raw, at)
            if hit is None:
                n = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                hit = n, raw[at : at + n]
            steps.append((at, hit[1]))
            at += hit[0]
        first = 0
        if self.trim:  # blanks in front go; a character that the map takes out ends them, and the mark in front begins there
            begin = next((i for i, (_, p) in enumerate(steps) if p != b" "), len(steps))
            if begin == len(steps):
                return "", np.array([len(raw)])
            first = steps[begin][0]
            kept, blank = [], True
            for where, piece in steps[begin:]:
                piece = piece.lstrip(b" ") if blank else piece
                if piece:
                    kept.append((where, piece))
                    blank = piece.endswith(b" ")
            steps = kept
        if self.prefix:
            put(b" ", first)
        for where, piece in steps:
            put(piece, where)
        end = len(raw)
        if self.trim:
            while out.endswith(mark):
                end = source[-3]
                del out[-3:], source[-3:]
        return out.decode(), np.array([*source, end], np.int64)

    # --- merging ---

    def merge(self, chunk: str) -> bytes:
        """Ids of a stretch that no piece crosses, as little-endian 32-bit integers."""
        parts, score = list(chunk), self.scores.get
        if len(parts) <= 40:
            least = -np.inf
            pairs = [score(a + b, least) for a, b in zip(parts, parts[1:], strict=False)]
            while pairs and (best := max(pairs)) > least:
                i = pairs.index(best)
                parts[i] += parts.pop(i + 1)
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = score(parts[i] + parts[i + 1], least)
                if i:
                    pairs[i - 1] = score(parts[i - 1] + parts[i], least)
        else:
            parts = self._merge_long(parts)
        out = []
        for p in parts:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.bytes[b] for b in p.encode())
            else:
                out.append(i)
        return struct.pack(f"<{len(out)}I", *out)

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of all pairs of pieces that merge, the merged ids, and the order of merging."""
        rank = {p: r for r, p in enumerate(sorted(self.ids, key=lambda p: -self.scores[p]))}
        rows = [(self.ids[p[:k]] << 32 | self.ids[p[k:]], i, rank[p]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        keys, ids, ranks = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True))
        return keys, ids, ranks

    def warm(self, norms: list[str]) -> None:
        """Merge all new words of some texts together, with arrays instead of a loop for each word."""
        seen: set[str] = set()
        for norm in norms:
            seen.update(norm.replace("\n", SPACE).split(SPACE))
        words = [w for w in seen if w and len(w) < 40 and w not in self.tail]
        if len(words) < 64:
            return
        size = np.array([len(w) + 1 for w in words])
        codes = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, where = np.unique(codes, return_inverse=True)
        ids = np.array([self.ids.get(chr(c), -1) for c in kinds], np.int64)[where]
        word = np.repeat(np.arange(len(words)), size)
        odd = np.zeros(len(words), bool)
        odd[word[ids < 0]] = True  # some character has no piece: left to merge()
        ids, word = ids[~odd[word]], word[~odd[word]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.ids)

        def look(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Order and result of merging the pieces at i and i + 1."""
            key = ids[i] << 32 | ids[i + 1]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = (self.pair_keys[at] == key) & (word[i] == word[i + 1])
            return np.where(hit, self.pair_ranks[at], none), self.pair_ids[at]

        rank, result = np.full(len(ids), none), np.zeros(len(ids), np.int64)
        if len(ids):
            rank[:-1], result[:-1] = look(np.arange(len(ids) - 1))
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(ids)))
            over = np.repeat(best == none, lengths)
            if over.any():
                done.append((ids[over], word[over]))
            pick = np.flatnonzero((rank == np.repeat(best, lengths)) & ~over)
            pick = pick[np.append(True, word[pick][1:] != word[pick][:-1])] if len(pick) else pick  # the leftmost
            ids[pick] = result[pick]
            keep = ~over
            keep[pick + 1] = False
            moved = (np.cumsum(keep) - 1)[pick]
            ids, word, rank, result = ids[keep], word[keep], rank[keep], result[keep]
            for i in (moved, moved - 1):
                last = i >= len(ids) - 1
                rank[i[last]] = none
                i = i[(i >= 0) & ~last]
                rank[i], result[i] = look(i)
        if not done:
            return
        ids, word = (np.concatenate(x) for x in zip(*done, strict=True))
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        if len(self.tail) + len(words) >= CACHE_WORDS:
            self.tail.clear()
        packed = ids.astype(np.uint32).tobytes()
        for w, a, b in zip(word[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
            self.tail[words[w]] = packed[4 * a : 4 * b]

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same merges from a heap, for stretches where rescanning would be quadratic."""
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (s := self.scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i] + parts[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if after[i] != j or not parts[j] or not parts[i] or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j], after[i] = piece, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p in parts if p]

    def merge_all(self, norm: str) -> np.ndarray:
        """Ids of a normalised text, without begin and end ids."""
        lines = []
        head, tail = self.head, self.tail
        for line in norm.split("\n"):
            words = line.split(SPACE)
            if "" in words[1:]:  # several blanks in a row
                lines.append(b"".join(map(head.__getitem__, re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line))))
            else:
                first = words.pop(0)
                lines.append((head[first] if first else b"") + b"".join(map(tail.__getitem__, words)))
        return np.frombuffer(head["\n"].join(lines), np.uint32)

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """encode() of each text."""
        known = [self.normalise(t or "") for t in texts]
        self.warm([norm for norm, _ in known])
        for text, given in zip(texts, known, strict=True):
            yield self.encode(text, given)

    def encode(self, text: str | None, given: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end ids, and each piece's span of source bytes."""
        text = text or ""
        norm, source = given or self.normalise(text)
        ids = self.merge_all(norm) if norm else np.zeros(0, np.uint32)
        if source is None and SPACE not in text:  # identity: a piece's surface has the bytes of its source
            ends = np.cumsum(self.surface_len[ids]) - int(self.prefix and bool(len(ids)))
            begins = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        else:
            if source is None:
                raw = text.encode()
                sizes = np.array([3 if c == " " else len(c.encode()) for c in text])
                where = np.cumsum([0, *(len(c.encode()) for c in text)])[:-1]
                source = np.concatenate([[0] * 3 * self.prefix, np.repeat(where, sizes), [len(raw)]]).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(self.norm_len[ids])])
            begins, ends = source[at[:-1]], source[at[1:]]
        begins, ends = np.maximum(begins, 0), np.maximum(ends, 0)
        size = len(text.encode())
        return (
            np.concatenate([[self.bos], ids, [self.eos]]).astype(np.uint32),
            np.concatenate([[0], begins, [size]]).astype(np.int64),
            np.concatenate([[0], ends, [size]]).astype(np.int64),
        )

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become the replacement character."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        size = self.surface_len[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.surface_at[ids] - ends + size, size) + np.arange(ends[-1])
        out = self.surface_bytes[at].tobytes()
        first = next((int(i) for i in ids[:3] if self.pieces[i][2] != CONTROL), None)
        if self.prefix and first is not None and self.pieces[first][0].startswith(SPACE):
            out = out[1:]
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", out.decode("utf-8", "surrogateescape")).encode()


class Words(dict):
    """Merged words; those not seen yet are merged when asked for. Holds CACHE_WORDS at most."""

    def __init__(self, codec: Codec, front: str):
        self.codec, self.front = codec, front

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self.codec.merge(self.front + word)
        if len(word) < 64:
            self[word] = out
        return out


_CODECS: dict[str, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """One codec for each model and worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def load_model(path: str) -> bytes:
    """A model file on the driver; its bytes (half a megabyte) travel with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keys`, ids array<int>, span_begin and span_end array<int> (source bytes), decoded string."""
    ship(docs.sparkSession)
    from pyspark.sql import types as T

    kinds = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*(kinds[k] for k in keys), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "span_begin", "span_end")), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for part in chunks(batch, text):
                rows = list(codec.encode_all(part.column(len(keys)).to_pylist()))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[k]) for r in rows)]), pa.int32()), pa.array(np.concatenate([r[k] for r in rows]).astype(np.int32))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keys))), *lists, pa.array([codec.decode(r[0]).decode() for r in rows], pa.string())], names=schema.names)

    return docs.select(*keys, text).mapInArrow(run, schema)


def digests(docs: DataFrame, model: bytes, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encode() boiled down inside the task, so that no id list leaves it: n_tokens, ids_sha256,
    decoded_sha256, and span_bytes (source bytes that the spans cover without gap or overlap)."""
    ship(docs.sparkSession)
    from pyspark.sql import types as T

    kinds = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*(kinds[k] for k in keys), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("span_bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            out: list[tuple] = []
            rows = (row for part in chunks(batch, text) for row in codec.encode_all(part.column(len(keys)).to_pylist()))
            for ids, begins, ends in rows:
                out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest(), int(np.sum(ends - begins))))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))], names=schema.names)

    return docs.select(*keys, text).mapInArrow(run, schema)
