"""Questionnaire scoring: constructs as expressions, static answers, centring, interactions and differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somaframe.config import Scale
from somaframe.functions.frames import SUBJECT

LOW, HIGH = 1, 5


def reversed_item(item: Column, low: int = LOW, high: int = HIGH) -> Column:
    return (low + high) - item


def strict_mean(values: Sequence[Column]) -> Column:
    """Null if any is missing."""
    return reduce(lambda a, b: a + b, values) / len(values)


def lenient_mean(values: Sequence[Column]) -> Column:
    """The mean of those that are there."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.try_divide(total, reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values]))


def construct(name: str, scales: dict[str, Scale], mean: object = strict_mean, low: int = LOW, high: int = HIGH, within: tuple[str, ...] = ()) -> Column:
    """A construct's score as one expression; its items may be constructs, unknown names are columns."""
    if name in within:
        raise ValueError(f"{name} is defined by itself")
    if name not in scales:
        return F.col(name).cast("double")
    scale = scales[name]
    parts = [construct(i, scales, mean, low, high, (*within, name)) for i in scale.items]
    return mean([reversed_item(p, low, high) if i in scale.reverse else p for i, p in zip(scale.items, parts, strict=True)])


def scored(answers: DataFrame, scales: dict[str, Scale], mean: object = strict_mean, shown: Sequence[str] | None = None, keep: Sequence[str] = (SUBJECT, "time")) -> DataFrame:
    """keep and the shown constructs (all, unless only totals are wanted)."""
    return answers.select(*keep, *(construct(n, scales, mean).alias(n) for n in (shown or scales)))


def stacked(times: dict[int, DataFrame]) -> DataFrame:
    """All time points below each other with `time`; columns that some lack are null there."""
    parts = [df.withColumn("time", F.lit(t)) for t, df in sorted(times.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def static_filled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each subject's first answer (by time) in all its rows."""
    own = Window.partitionBy(SUBJECT)
    return rows.withColumns({c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("time"))).over(own) for c in columns})


def hit_rate(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: the share of subjects for which a group is known."""
    return rows.select(SUBJECT).distinct().join(groups.select(SUBJECT).distinct().withColumn("_hit", F.lit(1.0)), SUBJECT, "left").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("hit_rate"))


def centred(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with x_c: less the mean over subjects of each subject's first answer."""
    first = rows.groupBy(SUBJECT).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("time"))).alias(c) for c in columns))
    means = first.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns))  # one row
    return rows.crossJoin(F.broadcast(means)).withColumns({f"{c}_c": F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*(f"_m_{c}" for c in columns))


def interactions(rows: DataFrame, columns: Sequence[str], condition: str = "task01") -> DataFrame:
    """rows with x_inter: the centred value times the condition."""
    return rows.withColumns({f"{c}_inter": F.col(f"{c}_c") * F.col(condition) for c in columns})


def time_deltas(rows: DataFrame, columns: Sequence[str], times: Sequence[int]) -> DataFrame:
    """rows with {name}{later}{earlier} for all pairs of times, the same in all rows of a subject."""
    own = Window.partitionBy(SUBJECT)
    at = lambda c, t: F.max(F.when(F.col("time") == t, F.col(c))).over(own)
    return rows.withColumns({f"{c}{b}{a}": at(c, b) - at(c, a) for c in columns for a, b in combinations(sorted(times), 2)})


def variable_sets(asked: dict[int, Sequence[str]]) -> tuple[list[int], list[str], list[str]]:
    """The times in order, the constructs asked for at two times or more (their differences make sense), and all."""
    times = sorted(asked)
    every = sorted({n for t in times for n in asked[t]})
    return times, [n for n in every if sum(n in asked[t] for t in times) > 1], every


def totals(scales: dict[str, Scale]) -> list[str]:
    """Constructs that are means of other constructs."""
    return [n for n, s in scales.items() if any(i in scales for i in s.items)]


def shown(asked: Sequence[str], scales: dict[str, Scale], only_totals: bool = True) -> list[str]:
    """What is put out: if only totals are wanted, without the constructs that totals asked for are made of."""
    hidden = {i for n in asked if n in totals(scales) for i in scales[n].items if i in scales} if only_totals else set()
    return [n for n in asked if n not in hidden]


def totals_updated(rows: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    """A scored table with its totals computed anew, strictly, from the columns that are there; one that is missing makes its
    totals null. In the order of the scales: later totals see earlier ones."""
    for name in totals(scales):
        have = set(rows.columns)
        parts = [F.col(i).try_cast("double") if i in have else F.lit(None).cast("double") for i in scales[name].items]
        rows = rows.withColumn(name, strict_mean(parts))
    return rows


def post_operations(rows: DataFrame, asked: dict[int, Sequence[str]], condition: str = "task01") -> DataFrame:
    """rows with differences of repeated constructs, and constructs of one time centred and times the condition."""
    times, repeated, every = variable_sets(asked)
    have = set(rows.columns)
    once = [n for n in every if n not in repeated and n in have]
    out = interactions(centred(rows, once), once, condition) if once else rows
    return time_deltas(out, [n for n in repeated if n in have], times)
