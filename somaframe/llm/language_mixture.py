"""Language identification by multilingual mixture inference (operator 6).

Each language is a distribution over hashed byte trigrams of lower-cased letters. A document is a mixture of
languages: expectation-maximisation finds the proportions that make its trigrams likeliest. The set of
languages grows from the best single one, by the language along which the likelihood rises fastest, as long
as the likelihood gains more than PENALTY * log(trigrams) for it. The likelihood is concave in the
proportions, so the slope bounds the gain: where even that bound is below the penalty, no fit is needed.

The prediction is the language with the largest proportion; the score is that proportion times the
posterior of the language among single languages (from a tempered likelihood, as trigrams overlap). Whether a
document is in known languages at all is another question: the (tempered) posterior of its mixture against an
unknown language, in which all buckets are equally likely. Filtering goes by that, so that texts in several
languages stay.

Rows learned from are a bounded sample: PER_LANGUAGE documents of each language in expectation, drawn by a
hash of doc_id. Everything else covers all rows and whole texts. All languages are learned; the model holds
their trigrams that occur (2^BITS at most), and a block of languages at a time is laid out in full.

Defined cases: a null text, or one without a letter, is `und` with score 0; where nothing could be learned
all are `und`; documents without a doc_id are predicted, never learned from; languages with equal
likelihood are taken in code point order; repeated rows get equal results; a very long text is counted in pieces, and
only its distinct trigrams are held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somaframe.llm._common import checkpoint, chunks, ship, text_bytes
from somaframe.llm.quality_ftrl import in_test_part

BITS = 16
PER_LANGUAGE = 3000
SMOOTHING = 0.5
PENALTY = 3.0
STEPS = 12
TEMPER = 4.0
UNKNOWN = "und"
#: Below this posterior of being in known languages, however many, a document is rejected where one is filtered by language.
LEAST_KNOWN = 0.3
#: Languages that are compared at once; there may be any number of blocks.
BLOCK = 32
BATCH_BYTES = 1 << 18
#: Bytes of a long text whose trigrams are counted at once.
PIECE_BYTES = 1 << 20

_FOLD = np.full(256, 32, np.uint8)  # what is no letter separates words
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _buckets(data: np.ndarray, lead: int, follow: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters and the buckets of the trigrams around them; lead and follow: the (folded) bytes before and after."""
    folded = np.empty(len(data) + 2, np.uint32)
    folded[0], folded[1:-1], folded[-1] = lead, _FOLD[data], follow
    live = np.flatnonzero(folded[1:-1] != 32)
    code = folded[live] << np.uint32(16) | folded[live + 1] << np.uint32(8) | folded[live + 2]
    return live, (code * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32)


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams of the texts (words with a blank on either side), how many of each there are, and where each
    text's buckets begin. Long texts are counted piece by piece."""
    n = len(at) - 1
    if n == 1 and len(data) > PIECE_BYTES:
        total = np.zeros(1 << BITS, np.int64)
        for k in range(0, len(data), PIECE_BYTES):
            end = min(len(data), k + PIECE_BYTES)
            total += np.bincount(_buckets(data[k:end], int(_FOLD[data[k - 1]]) if k else 32, int(_FOLD[data[end]]) if end < len(data) else 32)[1], minlength=1 << BITS)
        some = np.flatnonzero(total)
        return some.astype(np.int32), total[some], np.array([0, len(some)])
    apart = np.full(len(data) + n, 32, np.uint8)  # a blank behind every text
    apart[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = data
    where, bucket = _buckets(apart, 32, 32)
    text = np.searchsorted(at[1:] + np.arange(1, n + 1), where, "right")
    key, count = np.unique(text << BITS | bucket, return_counts=True)
    return (key & ((1 << BITS) - 1)).astype(np.int32), count, np.searchsorted(key, np.arange(n + 1) << BITS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs, empty ones included."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


class Languages:
    """The learned languages, in blocks: counts of trigrams as they are (sparse), one block at a time as probabilities."""

    def __init__(self, blocks: list[tuple[int, np.ndarray, np.ndarray]]):
        self.blocks = blocks  # languages of the block, cells (bucket * languages + language), counts
        self.kinds = sum(b[0] for b in blocks)
        self._only: np.ndarray | None = None

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """Number of the block's first language, and 2^BITS x languages."""
        lo = 0
        for width, cell, n in self.blocks:
            dense = self._only
            if dense is None:
                total = np.full((1 << BITS) * width, SMOOTHING)
                total[cell] += n
                total = total.reshape(-1, width)
                dense = total / total.sum(axis=0)
            if len(self.blocks) == 1:
                self._only = dense
            yield lo, dense
            lo += width


def mixtures(bucket: np.ndarray, times: np.ndarray, first: np.ndarray, model: Languages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its languages (-1: none) and their proportions, the posterior of the best single language among
    all, and the log likelihood of the mixture. All of it depends on the counts of the distinct trigrams only."""
    size, held, kinds = _sums(times, first), np.diff(first), model.kinds
    texts, row = np.arange(len(size)), np.repeat(np.arange(len(size)), held)
    fit, top, weight = np.full(len(size), -np.inf), np.zeros(len(size), np.int64), np.zeros(len(size))
    like = np.zeros((len(bucket), 1))  # of each trigram, in each language of its text
    for lo, block in model:
        single = np.stack([_sums(times * np.log(block[:, k])[bucket], first) for k in range(block.shape[1])], axis=1)
        best = single.argmax(axis=1)
        now = np.maximum(fit, single[texts, best])
        up = now > fit
        weight = weight * np.exp((fit - now) / TEMPER) + np.exp((single - now[:, None]) / TEMPER).sum(axis=1)
        top[up], fit, some = lo + best[up], now, up[row]
        like[some, 0] = block[bucket[some], best[row[some]]]
    who, share = top[:, None], np.ones((len(size), 1))
    todo = np.flatnonzero((size > 0) & (kinds > 1))
    while len(todo):
        n, m = size[todo], held[todo]
        own = np.repeat(first[todo] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        cuts, row, count = np.concatenate([[0], np.cumsum(m)]), np.repeat(np.arange(len(todo)), m), times[own]
        mixed = np.einsum("ij,ij->i", like[own], share[todo][row])
        steep, pick, add = np.full(len(todo), -np.inf), np.zeros(len(todo), np.int64), np.zeros(len(own))
        for lo, block in model:
            here = block[bucket[own]]
            slope = np.stack([_sums(count * here[:, k] / mixed, cuts) for k in range(block.shape[1])], axis=1) - n[:, None]
            at = who[todo] - lo
            text, place = np.nonzero((at >= 0) & (at < block.shape[1]))
            slope[text, at[text, place]] = -np.inf
            best = slope.argmax(axis=1)
            now = np.maximum(steep, slope[np.arange(len(todo)), best])
            up = now > steep
            pick[up], steep, some = lo + best[up], now, up[row]
            add[some] = here[some, best[row[some]]]
        price = PENALTY * np.log(n + 1)
        go = steep > price
        if not go.any():
            break
        keep = go[row]
        todo, pick, price, n, m, own, count = todo[go], pick[go], price[go], n[go], m[go], own[keep], count[keep]
        each_like = np.column_stack([like[own], add[keep]])
        row, cuts = np.repeat(np.arange(len(m)), m), np.concatenate([[0], np.cumsum(m)])
        p = share[todo]
        p = np.column_stack([np.where(p > 0, p * 0.8, 0.2), np.full(len(p), 0.2)])
        p /= p.sum(axis=1, keepdims=True)
        for _ in range(STEPS):
            each = each_like * p[row]
            each *= (count / each.sum(axis=1))[:, None]
            p = np.stack([_sums(each[:, k], cuts) for k in range(p.shape[1])], axis=1) / n[:, None]
        now = _sums(count * np.log(np.einsum("ij,ij->i", each_like, p[row])), cuts)
        better = now - fit[todo] > price
        some, todo = better[row], todo[better]
        who, share, like = (np.column_stack([x, np.full(len(x), none, x.dtype)]) for x, none in ((who, -1), (share, 0), (like, 0)))
        like[own[some]], who[todo, -1], share[todo], fit[todo] = each_like[some], pick[better], p[better], now[better]
        if who.shape[1] == kinds:
            break
    return who, share, 1 / weight, fit


def infer(bucket: np.ndarray, times: np.ndarray, first: np.ndarray, model: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) and log likelihoods of the mixtures."""
    who, share, _, fit = mixtures(bucket, times, first, model)
    out = np.zeros((len(who), model.kinds))
    text, place = np.nonzero(who >= 0)
    out[text, who[text, place]] = share[text, place]
    return out, fit


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], Languages]:
    """All languages in code point order, and their model."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~in_test_part(F.col("doc_id"), 5, 0))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    drawn = counts.select("lang", (F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))).alias("_most"))
    rows = rows.join(F.broadcast(drawn), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) < F.col("_most"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, total in held.items():
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for part in chunks(batch):
                bucket, times, first = trigrams(*text_bytes(part.column(1)))
                for i, lang in enumerate(part.column(0).to_pylist()):
                    if lang not in held:
                        if len(held) == BLOCK:
                            yield from out()
                        held[lang] = np.zeros(1 << BITS, np.int64)
                    held[lang][bucket[first[i] : first[i + 1]]] += times[first[i] : first[i + 1]]  # distinct buckets
        yield from out()

    found = checkpoint(rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in found.select("lang").distinct().collect())
    blocks = []
    for lo in range(0, len(langs), BLOCK):
        some = {x: k for k, x in enumerate(langs[lo : lo + BLOCK])}
        part = found.where(F.col("lang").isin(list(some))).toPandas()
        cell = part["bucket"].to_numpy(np.int32) * len(some) + part["lang"].map(some).to_numpy(np.int32)
        blocks.append((len(some), cell, part["n"].to_numpy(np.int64)))
    return langs, Languages(blocks)


def detect(docs: DataFrame, langs: list[str], model: Languages, keys: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Columns `keys`, lang_pred, score, shares (map of the selected languages' proportions) and known (posterior of the
    mixture against an unknown language); the text too if asked for."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((langs, model))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        for batch in batches:
            for part in chunks(batch, "text", BATCH_BYTES):
                texts = part.column(len(keys))
                if langs:
                    bucket, times, first = trigrams(*text_bytes(texts))
                    who, share, post, fit = mixtures(bucket, times, first, model)
                    known = 1 / (1 + np.exp(np.clip((-BITS * math.log(2) * _sums(times, first) - fit) / TEMPER, -500, 500)))
                    most = share.max(axis=1)
                    best = np.where((share == most[:, None]) & (who >= 0), who, len(langs)).min(axis=1)
                    # in a mixture the second language is no doubt about the first
                    score = np.where(most < 1, most, post)
                    rows = [(langs[b], float(s), [(langs[k], float(x)) for k, x in sorted(zip(w, p, strict=True)) if x > 0], float(c)) if has_letter(t) else (UNKNOWN, 0.0, [], 0.0) for t, b, s, w, p, c in zip(texts.to_pylist(), best, score, who, share, known, strict=True)]
                else:
                    rows = [(UNKNOWN, 0.0, [], 0.0)] * part.num_rows
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keys))), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.map_(pa.string(), pa.float64())), pa.array(columns[3], pa.float64()), *([texts] if with_text else [])], names=[*keys, "lang_pred", "score", "shares", "known", *(["text"] if with_text else [])])

    return docs.select(*keys, "text").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "lang_pred string, score double, shares map<string,double>, known double", *(["text string"] if with_text else [])]))


def keep_identified(docs: DataFrame, least_known: float = LEAST_KNOWN, per_language: int = PER_LANGUAGE) -> DataFrame:
    """docs without those that are `und` or in no known language (known below least_known); a null lang becomes the prediction."""
    langs, model = train(docs, per_language)
    others = [c for c in docs.columns if c != "text"]
    names = [f"_{i}" for i in range(len(others))]  # whatever the columns are called
    found = detect(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)), "text"), langs, model, tuple(names), with_text=True)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= least_known))
    back = dict(zip(others, names, strict=True)) | {"text": "text"}
    return kept.select(*((F.coalesce(F.col(back[c]), "lang_pred") if c == "lang" else F.col(back[c])).alias(c) for c in docs.columns))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = detect(docs, *train(docs, per_language))
    return found.select("doc_id", in_test_part(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
