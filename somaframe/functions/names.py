"""Names, ids and small string rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from somaframe.config import MISSING_WORDS, SIGNAL_WORDS


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def detect_signal(name: Column, words: dict[str, list[str]] = SIGNAL_WORDS) -> Column:
    """The first signal one of whose words is in the name, null if none."""
    low = F.lower(name)
    tests = [F.when(F.greatest(*(low.contains(w) for w in [*ws, ws[0]])), F.lit(signal)) for signal, ws in words.items()]
    return F.coalesce(*tests)


def padded(number: Column) -> Column:
    """At least three digits; longer numbers are not cut."""
    return F.format_string("%03d", number)


def infer_subject(name: Column) -> Column:
    """The subject id in a file name: P###S###T###R### upper-cased; f1o01-like ids; parts sub-, ses-, task-, run-
    by their first digits (1 if none); else the first number as participant; else null."""
    low = F.lower(name)
    parts = [found(low, rf"{p}-([a-z0-9]+)") for p in ("sub", "ses", "task", "run")]
    numbers = [F.coalesce(found(p, r"(\d+)").cast("int"), F.lit(1)) for p in parts]
    tagged = F.when(F.coalesce(*parts).isNotNull(), F.concat(*(x for tag, n in zip("PSTR", numbers, strict=True) for x in (F.lit(tag), padded(n)))))
    first = found(low, r"(\d+)").cast("int")
    plain = F.when(first.isNotNull(), F.concat(F.lit("P"), padded(first), F.lit("S001T001R001")))
    return F.coalesce(F.upper(found(low, r"(p\d{3}s\d{3}t\d{3}r\d{3})")), found(low, r"^(f[12][oy]\d{2})"), tagged, plain)


def merge_id(value: Column) -> Column:
    """A join key of mixed ids: the number after P, else a whole number, else the trimmed text."""
    text = value.cast("string")
    return F.coalesce(
        found(text, r"P(\d{3})").cast("int").cast("string"),
        text.try_cast("double").cast("bigint").cast("string"),
        F.trim(text),
    )


def numeric_id(value: Column) -> Column:
    """The number after a leading P, blanks and zeros dropped."""
    return found(value, r"^[Pp]\s*0*(\d+)").try_cast("bigint")


def coerce_int(value: Column) -> Column:
    return value.cast("string").try_cast("double").cast("bigint")


def blank_to_null(value: Column) -> Column:
    return F.when(~F.trim(value).isin(*MISSING_WORDS), F.trim(value))


def clean_meaning(value: Column) -> Column:
    """What stands before the first " ("."""
    return F.trim(F.substring_index(value, " (", 1))


def safe_name(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Za-z]+", "_")


def short_subject(value: Column) -> Column:
    return F.coalesce(found(value, r"^(P\d+)"), value)


def short_label(value: Column) -> Column:
    return F.coalesce(found(value, r"(P\d{3})"), value)


def sliced(value: Column, start: int, end: int) -> Column:
    """Characters start (from 0) up to end, without it."""
    return F.substring(value, start + 1, end - start)


def minutes(seconds: Column) -> Column:
    """mm:ss.mmm"""
    ms = F.bround(seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def hours(seconds: Column) -> Column:
    """H:MM:SS.mmm"""
    ms = F.bround(seconds * 1000).cast("bigint")
    return F.format_string("%d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
