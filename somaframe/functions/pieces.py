"""Ordered work on recordings of any length.

A window over all rows of a subject is one task. Pieces cut the rows of a subject, in their order, into parts of a fixed
number of rows: each row's place is the number of rows before its time cell, from counts of cells, and its place in the cell.
What looks a few rows around sees copies of its neighbours' rows; what depends on everything before (running sums, the last
good value) is summed up for each piece, carried over the pieces of the subject (few rows), and handed back to their rows.
All shuffles are by (subject, cell) or (subject, piece), so a subject with most of the rows is dealt like many subjects.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SUBJECT = "subject_id"


@dataclass(frozen=True)
class Pieces:
    """rows: how many rows a piece has; seconds: the width of the time cells in which places are counted first. A cell
    is one task's work, so it should hold about as many rows as a piece."""

    rows: int = 100_000
    seconds: float = 86_400.0

    def ranked(self, df: DataFrame, keys: Sequence[str] = (SUBJECT,), time: str = "t_s", tie: Sequence[str] = ("seq",)) -> DataFrame:
        """df with _rank (from 0, in the order of time and ties) and _piece."""
        end = F.lit((1 << 63) - 1)
        cell = F.when(F.isnan(time), end).otherwise(F.floor(F.col(time) / self.seconds))  # NaN is ordered last, null first
        rows = df.withColumn("_cell", cell)
        sizes = rows.groupBy(*keys, "_cell").agg(F.count("*").alias("_size"))
        before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = same(rows, sizes.select(*keys, "_cell", before.alias("_before")), [*keys, "_cell"])
        place = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(time, *tie)) - 1
        rows = rows.withColumn("_rank", F.col("_before") + place).withColumn("_piece", F.floor(F.col("_rank") / self.rows))
        return rows.drop("_cell", "_before")

    def bordered(self, ranked: DataFrame, reach: int) -> DataFrame:
        """ranked() with _at, the piece that sees the row: its own, and a neighbour if it is within reach rows of it."""
        if not 0 <= reach <= self.rows:
            raise ValueError("a piece must have as many rows as it looks around")
        at = F.array_distinct(F.array(F.floor((F.col("_rank") - reach) / self.rows), "_piece", F.floor((F.col("_rank") + reach) / self.rows)))
        return ranked.withColumn("_at", F.explode(F.filter(at, lambda p: p >= 0)))

    def around(self, df: DataFrame, reach: int, work: Callable[[DataFrame, WindowSpec], DataFrame], keys: Sequence[str] = (SUBJECT,), time: str = "t_s", tie: Sequence[str] = ("seq",)) -> DataFrame:
        """work(rows, order) over pieces with their borders; of its result the rows that a piece owns, still with _rank and _piece."""
        return work(self.bordered(self.ranked(df, keys, time, tie), reach), self.order(keys, "_at")).where("_at = _piece").drop("_at")

    @staticmethod
    def order(keys: Sequence[str] = (SUBJECT,), piece: str = "_piece") -> WindowSpec:
        return Window.partitionBy(*keys, piece).orderBy("_rank")

    @staticmethod
    def carried(rows: DataFrame, parts: dict[str, Column], over: dict[str, Callable[[WindowSpec], Column]], keys: Sequence[str] = (SUBJECT,)) -> DataFrame:
        """rows with the columns `over`: windows over the pieces of a subject, whose aggregates are `parts`."""
        pieces = rows.groupBy(*keys, "_piece").agg(*(c.alias(name) for name, c in parts.items()))
        order = Window.partitionBy(*keys).orderBy("_piece")
        return same(rows, pieces.select(*keys, "_piece", *(f(order).alias(name) for name, f in over.items())), [*keys, "_piece"])


def same(rows: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the other columns of more, which has one row for each of the keys, nulls among them."""
    other = more.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    joined = rows.join(other, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left")
    return joined.drop(*(f"_of_{k}" for k in keys))


def done(rows: DataFrame) -> DataFrame:
    return rows.drop("_rank", "_piece")


def last_before(rows: DataFrame, order: WindowSpec, fields: dict[str, Column], pieces: Pieces | None, keys: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """rows with, for each field, its last value there is in the rows before. With pieces, rows have _rank and _piece."""
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumns({name: F.last(value, True).over(back) for name, value in fields.items()})
    if pieces is None:
        return found
    parts = {name: F.max_by(value, F.when(value.isNotNull(), F.col("_rank"))) for name, value in fields.items()}
    over = {f"_c{name}": lambda w, name=name: F.last(name, True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for name in fields}
    return _filled(found, rows, parts, over, list(fields), keys)


def first_after(rows: DataFrame, order: WindowSpec, fields: dict[str, Column], pieces: Pieces | None, keys: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """rows with, for each field, its first value there is in the rows after."""
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    found = rows.withColumns({name: F.first(value, True).over(ahead) for name, value in fields.items()})
    if pieces is None:
        return found
    parts = {name: F.min_by(value, F.when(value.isNotNull(), F.col("_rank"))) for name, value in fields.items()}
    over = {f"_c{name}": lambda w, name=name: F.first(name, True).over(w.rowsBetween(1, Window.unboundedFollowing)) for name in fields}
    return _filled(found, rows, parts, over, list(fields), keys)


def _filled(found: DataFrame, rows: DataFrame, parts: dict, over: dict, names: list[str], keys: Sequence[str]) -> DataFrame:
    pieces = rows.groupBy(*keys, "_piece").agg(*(c.alias(name) for name, c in parts.items()))
    order = Window.partitionBy(*keys).orderBy("_piece")
    joined = same(found, pieces.select(*keys, "_piece", *(f(order).alias(name) for name, f in over.items())), [*keys, "_piece"])
    return joined.withColumns({n: F.coalesce(n, f"_c{n}") for n in names}).drop(*over)
