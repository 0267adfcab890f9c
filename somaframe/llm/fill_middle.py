"""Fill-in-the-middle examples by a parallel scan of an automaton (operator 12).

A text is cut into tokens (a word with the blanks before it; blanks at the end are a token of their own), two cuts
are drawn, and the text is given out as it is (plain), as prefix, suffix, middle (psm) or as suffix, prefix, middle
(spm), each part after its mark.

One automaton over bytes finds both the ends of tokens and the marks that forbid a rearrangement. Its states say whether the
byte before belongs to a word, how much of a mark has been read, and whether one has been found. Chunks of bytes are run from
every state at once: each gives the function from the state before it to the state behind it, and how many tokens end
in it for each state before it. Such functions compose associatively, so a scan over them gives every chunk the state
in which it begins. That is done twice:

* within a task, for STEP bytes a chunk, so that all chunks of a batch advance together in numpy;
* for texts of more than PIECE_BYTES, whose pieces are dealt to tasks as rows. Each row gives its function; the functions of
  one text are composed; the numbers of tokens before each piece select the piece that holds a cut; only those pieces are
  run again, from the state now known, to find the place.

Texts of up to PIECE_BYTES are not shuffled. A text is whole only in its own row, where the output is put together.

Defined cases: a null text is an empty one, and an empty text is plain with n = 0; a null doc_id draws as an empty number;
repeated rows give equal rows; texts of blanks are one token; other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somaframe.llm._common import checkpoint, safely_named, ship, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of a hundred texts so many are rearranged, and of a hundred of those so many begin with the suffix.
FIM_PERCENT, SPM_PERCENT = 50, 80
#: A text of more bytes is dealt to tasks in pieces of so many.
PIECE_BYTES = 1 << 18
#: Bytes that a lane of the scan goes through, and bytes scanned at once.
STEP, SCAN_BYTES = 256, 1 << 20

#: States: after a blank; in a word with nothing, the first, the first two characters of a mark read; a mark found, after a
#: blank and in a word.
STATES, FOUND = 6, 4
_IN_WORD = np.array([0, 1, 1, 1, 0, 1])
#: Classes of bytes: blank, the three characters of a mark, others; again for the first byte of a text; none.
_BLANK, _OPEN, _LETTER, _CLOSE, _OTHER, _FIRST, _NONE = 0, 1, 2, 3, 4, 5, 10
_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[[32, 9, 10, 11, 12, 13]] = _BLANK
_CLASS[ord("<")], _CLASS[ord(">")] = _OPEN, _CLOSE
_CLASS[[ord("P"), ord("S"), ord("M")]] = _LETTER


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a token ends before the byte, at class * STATES + state."""
    step, ends = np.zeros((_NONE + 1, STATES), np.int64), np.zeros((_NONE + 1, STATES), np.int64)
    for state in range(STATES):
        step[:_FIRST, state] = [4, 5, 5, 5, 5] if state >= FOUND else [0, 2, 3 if state == 2 else 1, 5 if state == 3 else 1, 1]
    ends[_BLANK] = _IN_WORD
    step[_FIRST:_NONE] = step[:_FIRST, :1]  # the first byte of a text forgets what stood before
    step[_NONE] = np.arange(STATES)
    return step.ravel(), ends.ravel()


_NEXT, _ENDS = _tables()


def _lanes(classes: np.ndarray) -> np.ndarray:
    """Classes times STATES, one row for each step of all lanes."""
    lanes = max(1, -(-len(classes) // STEP))
    padded = np.full(lanes * STEP, _NONE, np.int64)
    padded[: len(classes)] = classes
    return np.ascontiguousarray(padded.reshape(lanes, STEP).T) * STATES


def _functions(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each lane and state before it: the state behind it, and how many tokens end in it."""
    state = np.tile(np.arange(STATES), (lanes.shape[1], 1))
    ended = np.zeros_like(state)
    for row in lanes:
        at = row[:, None] + state
        state = _NEXT[at]
        ended += _ENDS[at]
    return state, ended


def composed(state: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Functions of all chunks up to each one, by doubling the number of chunks that a function covers."""
    state, ended, reach = state.copy(), ended.copy(), 1
    while reach < len(state):
        before = state[:-reach]
        own = np.take_along_axis(state[reach:], before, 1)
        count = ended[:-reach] + np.take_along_axis(ended[reach:], before, 1)
        state[reach:], ended[reach:], reach = own, count, 2 * reach
    return state, ended


def piece_function(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The function of a piece of a text."""
    state, ended = composed(*_functions(_lanes(_CLASS[data])))
    return state[-1], ended[-1]


def run(classes: np.ndarray, state: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The state behind each byte, and the bytes before which a token ends."""
    lanes = _lanes(classes)
    after, _ = composed(*_functions(lanes))
    now = np.append(state, after[:-1, state])  # the state before each lane
    states, ends = np.zeros(lanes.shape, np.uint8), np.zeros(lanes.shape, bool)
    for i, row in enumerate(lanes):
        at = row + now
        now = _NEXT[at]
        states[i], ends[i] = now, _ENDS[at]
    return states.T.ravel()[: len(classes)], np.flatnonzero(ends.T.ravel()[: len(classes)])


def _chars(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and in all."""
    return np.append(0, np.cumsum((data & 0xC0) != 0x80))


def cuts(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> dict[str, np.ndarray]:
    """Of whole texts: the number of tokens, whether a mark is in it, and both cuts in code points."""
    data, at = text_bytes(texts)
    out = {k: np.zeros(len(texts), np.int64) for k in ("n", "marked", "first", "second")}
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SCAN_BYTES, "right")) - 1)
        part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
        some = np.diff(own) > 0
        classes = _CLASS[part]
        classes[own[:-1][some]] += _FIRST
        states, ends = run(classes)
        chars, first = _chars(part), np.searchsorted(ends, own)
        out["n"][i:j] = n = np.diff(first) + some
        out["marked"][i:j][some] = states[own[1:][some] - 1] >= FOUND
        drawn = np.sort([h1[i:j] % (n + 1), h2[i:j] % (n + 1)], axis=0)
        ends = np.append(ends, 0)  # is looked up, and not used, where nothing ends
        for name, k in zip(("first", "second"), drawn, strict=True):
            place = np.where(k == 0, own[:-1], np.where(k == n, own[1:], ends[np.minimum(first[:-1] + k - 1, len(ends) - 1)]))
            out[name][i:j] = chars[place] - chars[own[:-1]]
        i = j
    return out


_CUTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("marked", T.BooleanType()), T.StructField("first", T.LongType()), T.StructField("second", T.LongType())])


@F.arrow_udf(_CUTS)
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    found = cuts(text, h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(found["n"]), pa.array(found["marked"].astype(bool)), pa.array(found["first"]), pa.array(found["second"])], names=_CUTS.names)


_FUNCTION = T.StructType([T.StructField("states", T.ArrayType(T.IntegerType())), T.StructField("ended", T.ArrayType(T.LongType())), T.StructField("chars", T.LongType())])


def _blobs(column: pa.Array) -> Iterator[np.ndarray]:
    data, at = text_bytes(column)
    return (data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


@F.arrow_udf(_FUNCTION)
def _piece_functions(piece: pa.Array) -> pa.Array:
    found = [(*piece_function(d), int(((d & 0xC0) != 0x80).sum())) for d in _blobs(piece)]
    return pa.array([{"states": s.tolist(), "ended": e.tolist(), "chars": c} for s, e, c in found], pa.struct([("states", pa.list_(pa.int32())), ("ended", pa.list_(pa.int64())), ("chars", pa.int64())]))


@F.arrow_udf(T.LongType())
def _place(piece: pa.Array, state: pa.Array, k: pa.Array) -> pa.Array:
    """Code points of the piece before the end of its k-th token, when it begins in that state."""
    found = []
    for data, s, nth in zip(_blobs(piece), state.to_pylist(), k.to_pylist(), strict=True):
        _, ends = run(_CLASS[data], s)
        found.append(int(((data[: ends[nth - 1]] & 0xC0) != 0x80).sum()))
    return pa.array(found, pa.int64())


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four integers below 2^32 for each document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _pieces(giants: DataFrame, size: int) -> DataFrame:
    """_key, _h1, _h2, _place, _piece: giants cut at code points into pieces of about size bytes; each text once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(_blobs(batch.column(3))):
                lo = place = 0
                while lo < len(data):
                    hi = min(lo + size, len(data))
                    while hi < len(data) and data[hi] & 0xC0 == 0x80:
                        hi += 1
                    own = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array([place], pa.int64()), pa.array([data[lo:hi].tobytes()], pa.binary())], names=["_key", "_h1", "_h2", "_place", "_piece"])
                    lo, place = hi, place + 1

    pieces = giants.select("_key", "_h1", "_h2", "text").mapInArrow(cut, "_key string, _h1 long, _h2 long, _place long, _piece binary")
    return pieces.groupBy("_key", "_h1", "_h2", "_place").agg(F.any_value("_piece").alias("_piece"))


def _selected(functions: pd.DataFrame) -> pd.DataFrame:
    """Two rows for a text: which piece holds the cut, the state in which it begins, which of its tokens ends there (none: the
    beginning of the text or its end) and the code points before it. A group is as many rows as one text has pieces."""
    f = functions.sort_values("_place").reset_index(drop=True)
    states, ended = composed(np.array(f["states"].tolist()), np.array(f["ended"].tolist()))
    begins, before = np.append(0, states[:-1, 0]), np.append(0, ended[:, 0])
    chars = np.append(0, np.cumsum(f["chars"].to_numpy()))
    n = int(before[-1]) + 1  # these texts are not empty
    rows = []
    for k in sorted((int(f["_h1"][0]) % (n + 1), int(f["_h2"][0]) % (n + 1))):
        if k in (0, n):
            rows.append((None, None, None, 0 if k == 0 else chars[-1]))
        else:
            p = int(np.searchsorted(before, k, "left")) - 1  # the first piece behind which k tokens have ended
            rows.append((p, begins[p], k - before[p], chars[p]))
    out = pd.DataFrame(rows, columns=["_place", "_state", "_nth", "_chars"]).astype({"_place": "Int64", "_state": "Int64", "_nth": "Int64", "_chars": "int64"})
    return out.assign(_key=f["_key"][0], _n=n, _marked=bool(states[-1, 0] >= FOUND))[["_key", "_n", "_marked", "_place", "_state", "_nth", "_chars"]]


def _of_giants(giants: DataFrame, pieces: DataFrame) -> DataFrame:
    """giants with _cut, as _cuts() gives it for texts in one piece."""
    functions = pieces.withColumn("_f", _piece_functions("_piece")).select("_key", "_h1", "_h2", "_place", "_f.*")
    wanted = functions.groupBy("_key").applyInPandas(_selected, "_key string, _n long, _marked boolean, _place long, _state int, _nth long, _chars long")
    there = wanted.where("_place IS NOT NULL").join(pieces.select("_key", "_place", "_piece"), ["_key", "_place"]).withColumn("_in", _place("_piece", "_state", "_nth"))
    ends = wanted.where("_place IS NULL").withColumn("_in", F.lit(0).cast("long"))
    columns = ["_key", "_n", "_marked", (F.col("_chars") + F.col("_in")).alias("_at")]
    found = there.select(*columns).unionByName(ends.select(*columns)).groupBy("_key").agg(F.min("_n").alias("n"), F.min("_marked").alias("marked"), F.min("_at").alias("first"), F.max("_at").alias("second"))
    return giants.join(found.select("_key", F.struct("n", "marked", "first", "second").alias("_cut")), "_key")


def examples(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, piece: int = PIECE_BYTES) -> DataFrame:
    """docs with n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), and output."""
    ship(docs.sparkSession)
    named, restored = safely_named(docs, "doc_id", "text")
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    named = named.withColumns({"_whole": F.coalesce("text", F.lit("")), "_h1": h1, "_h2": h2})
    few = named.where(F.octet_length("_whole") <= piece).withColumn("_cut", _cuts("_whole", "_h1", "_h2"))
    giants = named.where(F.octet_length("_whole") > piece).withColumn("_key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)))
    pieces = checkpoint(_pieces(giants, piece))
    if not pieces.isEmpty():
        few = few.unionByName(_of_giants(giants, pieces).select(*few.columns))
    marked, first, second, text = F.col("_cut.marked"), F.col("_cut.first").cast("int"), F.col("_cut.second").cast("int"), F.col("_whole")
    plain = (text == "") | marked | (h3 % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.length(text) - second)
    laid = few.withColumn("_form", form).withColumn(
        "_output",
        F.when(F.col("_form") == "plain", text)
        .when(F.col("_form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)),
    )
    ours = {"n": F.col("_cut.n"), "form": F.col("_form"), "prefix_chars": F.when(F.col("_form") != "plain", F.col("_cut.first")), "middle_chars": F.when(F.col("_form") != "plain", F.col("_cut.second") - F.col("_cut.first")), "output": F.col("_output")}
    return laid.select(*(c for c, name in zip(restored, docs.columns, strict=True) if name not in ours), *(c.alias(name) for name, c in ours.items()))


def restore(output: Column, form: Column) -> Column:
    """The text from an output: a rearranged text holds no mark of its own, so the three marks cut it into its parts."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
