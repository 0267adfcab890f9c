"""Building analysis tables: joins with groups, wide and long forms, merging questionnaires, tidying columns.

Decisions about columns (which are static, equal, or empty) come from one aggregate row per table; the driver
only ever sees that row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somaframe.config import LABELLED_WINDOWS, MISSING_WORDS, WindowDef
from somaframe.functions.names import clean_meaning

#: Window numbers of the four-phase design.
PHASES = {1: "baseline", 2: "induction", 3: "intervention", 4: "recovery"}
#: Codes of the phases in long tables.
PHASE_CODES = {"baseline": 1, "induction": 2, "intervention": 3}


def with_groups(features: DataFrame, groups: DataFrame, column: str = "task", key: str = "subject_id") -> DataFrame:
    """features with each subject's group; of several group rows the lowest counts, none leaves null."""
    one = groups.groupBy(key).agg(F.min(column).alias(column))
    return features.join(one, key, "left")


def without_group(features: DataFrame, groups: DataFrame, key: str = "subject_id") -> DataFrame:
    return features.select(key).distinct().join(groups.select(key), key, "left_anti")


def conflicting(groups: DataFrame, column: str = "task", key: str = "subject_id") -> DataFrame:
    """Subjects in more than one group."""
    return groups.groupBy(key).agg(F.count_distinct(column).alias("n")).where("n > 1")


def expanded(wanted: Sequence[str], columns: Sequence[str]) -> list[str]:
    """The wanted columns that are there, and their _ws and _bs families, in order."""
    have = set(columns)
    return sorted({c for w in wanted for c in (w, f"{w}_ws", f"{w}_bs") if c in have})


def phase(w_id: Column, phases: dict[int, str] = PHASES) -> Column:
    return F.coalesce(*(F.when(w_id == k, v) for k, v in phases.items()))


def wide(rows: DataFrame, key: str, label: str, labels: Sequence[str], values: Sequence[str], order: str, prefix: str = "") -> DataFrame:
    """One row per key, a column value_label for each value and label: the first non-null by `order`. One
    aggregation without a pivot's pass for its labels; unknown labels are ignored."""
    cells = [F.min_by(v, F.when((F.col(label) == x) & F.col(v).isNotNull(), F.col(order))).alias(f"{v}_{prefix}{x}") for v in values for x in labels]
    return rows.groupBy(key).agg(*cells)


def renamed_times(columns: Sequence[str]) -> dict[str, str]:
    """t{n}_name becomes name_T{n}."""
    return {c: f"{m[2]}_T{m[1]}" for c in columns if (m := re.match(r"t(\d+)_(.+)$", c))}


def joined_once(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join of two tables of one row per key; repeated keys are an error when the query runs."""
    n = F.count("*").over(Window.partitionBy(key))
    one = lambda df: df.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated {key}"))).otherwise(F.col("_n")))
    checked = [x.where("_n = 1").drop("_n") for x in (one(left), one(right))]
    return checked[0].join(checked[1], key, "left")


def scheme(spark: object, definitions: Sequence[WindowDef] = LABELLED_WINDOWS, psycho: str = "g") -> DataFrame:
    """meaning, role (gap or phase), phase_level, t_level, col_suffix, t_id of each labelled window. Windows of the
    questionnaire category are times t1, t2, … in their order."""
    rows, t = [], 0
    for d in definitions:
        category, _, rest = d.name.partition("_")
        gap = category == psycho
        t += gap
        rows.append((d.name, "gap" if gap else "phase", None if gap else rest, f"t{t}" if gap else None, f"t{t}" if gap else rest, t if gap else None))
    return spark.createDataFrame(rows, "meaning string, role string, phase_level string, t_level string, col_suffix string, t_id int")


def labelled(features: DataFrame, scheme: DataFrame) -> DataFrame:
    """features with the scheme's columns; unknown meanings are phases without a suffix."""
    named = features.withColumn("_meaning", clean_meaning(F.col("meaning")))
    known = F.broadcast(scheme.withColumnRenamed("meaning", "_known"))  # one row for each window definition
    found = named.join(known, F.col("_meaning") == F.col("_known"), "left").drop("_known", "_meaning")
    return found.withColumn("role", F.coalesce("role", F.lit("phase")))


def long_table(features: DataFrame, scheme: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row for each subject and window, with the scheme's columns and the code of the phase."""
    rows = labelled(features, scheme)
    code = F.coalesce(*(F.when(F.col("phase_level") == k, v) for k, v in PHASE_CODES.items()))
    return rows.select("subject_id", "task", "w_id", "t_id", "role", "phase_level", "t_level", code.alias("phase_level_code"), "meaning", *values)


def with_questionnaires(long: DataFrame, psycho: DataFrame, values: Sequence[str], key: str = "subject_id", time: str | None = "time") -> DataFrame:
    """long with questionnaire values of the same subject and time (t_id); rows without a time get none. Without
    time, by subject. Of several answers the lowest counts."""
    by = [key, *([time] if time else [])]
    one = psycho.groupBy(*by).agg(*(F.min(v).alias(v) for v in values))
    one = one.select(F.col(key).alias("_k"), *([F.col(time).alias("_t")] if time else []), *values)
    on = F.col(key) == F.col("_k")
    return long.join(one, on & (F.col("t_id") == F.col("_t")) if time else on, "left").drop("_k", "_t")


def static_columns(rows: DataFrame, columns: Sequence[str], key: str = "subject_id", time: str = "time", share: float = 0.9) -> list[str]:
    """Columns of which at least such a share of subjects has one value or none, over two times or more."""
    each = rows.groupBy(key).agg(*(F.count_distinct(c).alias(c) for c in columns))
    found = each.agg(*(F.avg((F.col(c) <= 1).cast("double")).alias(c) for c in columns)).first()
    times = rows.select(time).distinct().limit(2).count()
    return [c for c in columns if times > 1 and found[c] is not None and found[c] >= share]


def by_time(rows: DataFrame, columns: Sequence[str], times: Sequence[int], static: Iterable[str] = (), key: str = "subject_id", time: str = "time") -> DataFrame:
    """One row per subject: value_T{time} for each time, static columns as they are at the last time."""
    static = set(static)
    cells = [F.min_by(c, F.when((F.col(time) == t) & F.col(c).isNotNull(), F.col(time))).alias(c if c in static else f"{c}_T{t}") for c in columns for t in (times[-1:] if c in static else times)]
    return rows.groupBy(key).agg(*cells)


def collapsed(wide: DataFrame) -> DataFrame:
    """wide with base_T1, base_T2, … that never differ in a row (where they are there) as one column, base: its value at
    the highest time that has one. It stands where the highest stood."""
    families: dict[str, list[tuple[int, str]]] = {}
    for c in wide.columns:
        if m := re.match(r"(.+)_T(\d+)$", c):
            families.setdefault(m[1], []).append((int(m[2]), c))
    many = {b: [c for _, c in sorted(cs, reverse=True)] for b, cs in families.items() if len(cs) > 1}
    if not many:
        return wide
    kinds = lambda cs: F.size(F.array_distinct(F.array_compact(F.array(*(F.col(f"`{c}`") for c in cs)))))
    most = wide.agg(*(F.max(kinds(cs)).alias(f"m{i}") for i, cs in enumerate(many.values()))).first()
    same = {b: cs for i, (b, cs) in enumerate(many.items()) if (most[i] or 0) <= 1}
    top, gone = {cs[0]: b for b, cs in same.items()}, {c for cs in same.values() for c in cs[1:]}
    return wide.select(*(F.coalesce(*(F.col(f"`{x}`") for x in same[top[c]])).alias(top[c]) if c in top else F.col(f"`{c}`") for c in wide.columns if c not in gone))


def filled_columns(df: DataFrame, keep: Iterable[str] = ()) -> list[str]:
    """Columns with any value, and those to keep; blank and NA-like texts are no values."""
    def value(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.when(~F.trim(c).isin(*MISSING_WORDS), c) if isinstance(f.dataType, T.StringType) else c

    counts = df.agg(*(F.count(value(f)).alias(f"c{i}") for i, f in enumerate(df.schema.fields))).first()
    keep = set(keep)
    return [c for i, c in enumerate(df.columns) if counts[i] or c in keep]


def with_deltas(wide: DataFrame, base: str = "stai") -> DataFrame:
    """d_{base}_induction (T2 - T1) and d_{base}_intervention (T3 - T2), where both are there."""
    have = set(wide.columns)
    out = wide
    for name, (a, b) in {"induction": (1, 2), "intervention": (2, 3)}.items():
        if {f"{base}_T{a}", f"{base}_T{b}"} <= have:
            out = out.withColumn(f"d_{base}_{name}", F.col(f"{base}_T{b}") - F.col(f"{base}_T{a}"))
    return out
