"""Random-intercept linear mixed models by maximum likelihood, from sufficient statistics.

Cells are combinations of condition and time. A subject enters through its size (its number of rows) and its cells' counts and
sums only, and subjects of one size add up. One aggregation gives these sums for all dependent variables, sizes, cells and pairs of
cells at once, in long form. The driver then maximises each likelihood in one number, the ratio of the variances.

Sums over sizes are all that the likelihood at a given ratio needs. Where there are more numbers than the driver should
take (very many different sizes), Spark adds up those sums for a grid of ratios of each variable, and the grid narrows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somaframe.functions.folders import checkpoint
from somaframe.functions.frames import SUBJECT
from somaframe.functions.kernels import chi2_tail, normal_tail

#: Numbers of the statistics that the driver takes at once; beyond, sums over sizes stay in Spark.
MOST_NUMBERS = 5_000_000
#: Logarithms of the ratios that are tried first, and how many points each narrower grid has.
FIRST_GRID, GRID = np.linspace(-20.0, 20.0, 81), 41
_SUMS = ("subjects", "yy", "y2", "c", "s", "cy", "cc")


def cell_sums(rows: DataFrame, values: Sequence[str], condition: str = "task", time: str = "t_id") -> DataFrame:
    """dv, n (size), a and b (cells, null where a sum is not of one), and the sums _SUMS over the subjects of that size: how many, sums of
    squares and squares of sums (no cell); count, sum, and count times the subject's sum (cell a); products of counts (cells a, b)."""
    long = rows.select(SUBJECT, F.struct(F.col(condition).alias("condition"), F.col(time).alias("time")).alias("cell"), F.explode(F.array(*(F.struct(F.lit(v).alias("dv"), F.col(v).cast("double").alias("y")) for v in values))).alias("_x"))
    used = long.select(SUBJECT, "cell", "_x.*").where("y IS NOT NULL AND cell.condition IS NOT NULL AND cell.time IS NOT NULL")
    each = used.groupBy("dv", SUBJECT, "cell").agg(F.count("*").cast("double").alias("c"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    own = each.groupBy("dv", SUBJECT).agg(F.collect_list(F.struct("cell", "c", "s")).alias("cells"), F.sum("c").cast("long").alias("n"), F.sum("s").alias("y"), F.sum("q").alias("yy"))
    none, zero = F.lit(None).cast(used.schema["cell"].dataType), F.lit(0.0)
    sums = lambda a, b, **known: F.struct(a.alias("a"), b.alias("b"), *(known.get(name, zero).cast("double").alias(name) for name in _SUMS))
    whole = F.array(sums(none, none, subjects=F.lit(1.0), yy=F.col("yy"), y2=F.col("y") * F.col("y")))
    cells = F.transform("cells", lambda x: sums(x.cell, none, c=x.c, s=x.s, cy=x.c * F.col("y")))
    pairs = F.flatten(F.transform("cells", lambda x: F.transform(F.filter("cells", lambda z: z.cell >= x.cell), lambda z: sums(x.cell, z.cell, cc=x.c * z.c))))
    parts = own.select("dv", "n", F.explode(F.concat(whole, cells, pairs)).alias("_s")).select("dv", "n", "_s.*")
    return parts.groupBy("dv", "n", "a", "b").agg(*(F.sum(name).alias(name) for name in _SUMS))


def statistics(rows: DataFrame, value: str, cells: Sequence[tuple], condition: str = "task", time: str = "t_id") -> DataFrame:
    """cell_sums() of one variable, one row for each size, with a column for each sum of the given cells (by their place)."""
    at = lambda c, cell: (F.col(f"{c}.condition") == cell[0]) & (F.col(f"{c}.time") == cell[1])
    alone, single = F.col("a").isNull(), F.col("b").isNull()
    pick = lambda when, name, alias: F.coalesce(F.max(F.when(when, F.col(name))), F.lit(0.0)).alias(alias)
    p = range(len(cells))
    return cell_sums(rows, [value], condition, time).groupBy("n").agg(
        F.max(F.when(alone, F.col("subjects"))).cast("long").alias("subjects"), *(pick(alone, name, name) for name in ("yy", "y2")),
        *(pick(single & at("a", c), "c", f"c{i}").cast("long").alias(f"c{i}") for i, c in enumerate(cells)), *(pick(single & at("a", c), "s", f"s{i}") for i, c in enumerate(cells)),
        *(pick(single & at("a", c), "cy", f"cy{i}") for i, c in enumerate(cells)),
        *(pick(F.col("b").isNotNull() & ((at("a", cells[i]) & at("b", cells[j])) | (at("a", cells[j]) & at("b", cells[i]))), "cc", f"cc{i}_{j}").cast("long").alias(f"cc{i}_{j}") for i in p for j in p if j >= i),
    )


@dataclass
class Fit:
    """Cell means and their covariance, variances, and the likelihood."""

    cells: list[tuple]
    means: np.ndarray
    covariance: np.ndarray
    residual: float
    between: float
    loglik: float
    n_obs: int
    n_groups: int

    @property
    def parameters(self) -> int:
        """Fixed effects, and two variances."""
        return len(self.means) + 2

    def table(self) -> pd.DataFrame:
        k = self.parameters
        return pd.DataFrame([{"n_obs": self.n_obs, "n_groups": self.n_groups, "loglik": self.loglik, "aic": 2 * k - 2 * self.loglik, "bic": k * math.log(self.n_obs) - 2 * self.loglik, "var_between": self.between, "var_residual": self.residual}])

    def levels(self) -> tuple[list, list]:
        return sorted({c for c, _ in self.cells}), sorted({t for _, t in self.cells})

    def contrast(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows @ self.means, rows @ self.covariance @ rows.T

    def cell(self, condition: object, time: object) -> np.ndarray:
        return np.array([float(c == (condition, time)) for c in self.cells])

    def treatment(self) -> tuple[list[str], np.ndarray]:
        """Names and rows of the treatment-coded effects (first sorted level as reference)."""
        conditions, times = self.levels()
        base = self.cell(conditions[0], times[0])
        names, rows = ["Intercept"], [base]
        for c in conditions[1:]:
            names.append(f"condition[{c}]")
            rows.append(self.cell(c, times[0]) - base)
        for t in times[1:]:
            names.append(f"time[{t}]")
            rows.append(self.cell(conditions[0], t) - base)
        for c in conditions[1:]:
            for t in times[1:]:
                names.append(f"condition[{c}]:time[{t}]")
                rows.append(self.cell(c, t) - self.cell(c, times[0]) - self.cell(conditions[0], t) + base)
        return names, np.array(rows)

    def effects(self, level: float = 0.95) -> pd.DataFrame:
        names, rows = self.treatment()
        return _tests(names, *self.contrast(rows), level)

    def wald(self) -> pd.DataFrame:
        """Chi-square tests of the terms under treatment coding: main effects are those at the reference level."""
        names, rows = self.treatment()
        out = []
        for term, pick in (("condition", lambda n: n.startswith("condition") and ":" not in n), ("time", lambda n: n.startswith("time")), ("condition:time", lambda n: ":" in n)):
            own = rows[[i for i, n in enumerate(names) if pick(n)]]
            if len(own):
                value, cov = self.contrast(own)
                chi2 = float(value @ np.linalg.solve(cov, value))
                out.append({"term": term, "chi2": chi2, "df": len(own), "p": chi2_tail(chi2, len(own))})
        return pd.DataFrame(out)

    def marginal(self, factor: str) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Means of a factor's levels, cells weighing equally, and their pairwise differences with Bonferroni's p."""
        conditions, times = self.levels()
        levels, others = (conditions, times) if factor == "condition" else (times, conditions)
        pair = (lambda a, b: self.cell(a, b)) if factor == "condition" else (lambda a, b: self.cell(b, a))
        rows = np.array([np.mean([pair(a, b) for b in others], axis=0) for a in levels])
        return _tests([str(x) for x in levels], *self.contrast(rows)), _pairs([str(x) for x in levels], rows, self)

    def simple(self, factor: str) -> pd.DataFrame:
        """Pairwise differences of a factor's levels at each level of the other."""
        conditions, times = self.levels()
        levels, others = (conditions, times) if factor == "condition" else (times, conditions)
        parts = []
        for b in others:
            rows = np.array([self.cell(a, b) if factor == "condition" else self.cell(b, a) for a in levels])
            parts.append(_pairs([str(x) for x in levels], rows, self).assign(at=str(b)))
        return pd.concat(parts, ignore_index=True)


def _tests(names: Sequence[str], value: np.ndarray, cov: np.ndarray, level: float = 0.95) -> pd.DataFrame:
    from statistics import NormalDist

    se = np.sqrt(np.maximum(np.diag(cov), 0))
    z = value / np.where(se > 0, se, np.nan)
    q = NormalDist().inv_cdf(0.5 + level / 2)
    return pd.DataFrame({"name": list(names), "estimate": value, "se": se, "z": z, "p": [normal_tail(x) if x == x else float("nan") for x in z], "low": value - q * se, "high": value + q * se})


def _pairs(names: Sequence[str], rows: np.ndarray, fit: Fit) -> pd.DataFrame:
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))]
    if not pairs:
        return pd.DataFrame(columns=["name", "estimate", "se", "z", "p", "low", "high", "p_bonferroni"])
    d = np.array([rows[j] - rows[i] for i, j in pairs])
    out = _tests([f"{names[j]} - {names[i]}" for i, j in pairs], *fit.contrast(d))
    return out.assign(p_bonferroni=np.minimum(1, out["p"] * len(pairs)))


@dataclass
class _Sums:
    """Of one variable: its cells, and per weight function (row) the sums over sizes, weighted. Row 0 has weights of one."""

    cells: list[tuple]
    subjects: np.ndarray
    yy: np.ndarray
    y2: np.ndarray
    c: np.ndarray
    s: np.ndarray
    cy: np.ndarray
    cc: np.ndarray
    log: np.ndarray  # of 1 + ratio * size, over subjects
    rows: float

    def solved(self, k: int) -> tuple[float, np.ndarray, np.ndarray, float]:
        """Likelihood, cell means, their covariance and the residual variance at the ratio of row k."""
        a = np.diag(self.c[0]) - self.cc[k]
        inverse = np.linalg.inv(a)
        beta = inverse @ (self.s[0] - self.cy[k])
        s2 = max((self.yy[0] - self.y2[k] - beta @ (self.s[0] - self.cy[k])) / self.rows, 1e-300)
        return -0.5 * (self.rows * math.log(2 * math.pi * s2) + self.log[k] + self.rows), beta, s2 * inverse, s2


class _Table:
    """The sums of one variable as arrays over its sizes."""

    def __init__(self, table: pd.DataFrame):
        # rows of structs come as dicts where the session hands tables over in Arrow's form
        cell = lambda c: None if c is None else tuple(c.values() if isinstance(c, dict) else c)
        cells = sorted({cell(c) for c in table["a"]} - {None})
        place = {c: i for i, c in enumerate(cells)} | {None: -1}
        at, to = (np.array([place[cell(c)] for c in table[k]]) for k in ("a", "b"))
        self.cells, (self.sizes, size), p = cells, np.unique(table["n"].to_numpy(float), return_inverse=True), len(cells)
        alone, single, pair = at < 0, (at >= 0) & (to < 0), to >= 0
        self.subjects, self.yy, self.y2 = (self._filled((), table[k].to_numpy(float)[alone], (size[alone],)) for k in ("subjects", "yy", "y2"))
        self.c, self.s, self.cy = (self._filled((p,), table[k].to_numpy(float)[single], (size[single], at[single])) for k in ("c", "s", "cy"))
        self.cc = self._filled((p, p), table["cc"].to_numpy(float)[pair], (size[pair], at[pair], to[pair]))
        self.cc = np.maximum(self.cc, self.cc.transpose(0, 2, 1))  # each pair of cells was summed once; counts are not negative
        self.rows = float(self.c.sum())

    def _filled(self, shape: tuple[int, ...], values: np.ndarray, at: tuple) -> np.ndarray:
        out = np.zeros((len(self.sizes), *shape))
        out[at] = values
        return out

    def weighted(self, weights: np.ndarray, logs: np.ndarray, rows: float) -> _Sums:
        """weights, logs: one row for each weight function, one column for each size."""
        sums = {k: np.tensordot(weights, getattr(self, k), 1) for k in ("subjects", "yy", "y2", "c", "s", "cy", "cc")}
        return _Sums(self.cells, **sums, log=logs @ self.subjects, rows=rows)


def _fit(sums: _Sums, ratios: Sequence[float]) -> Fit:
    """The fit at the best of the ratios, the first (none between subjects) if it is as good."""
    found = [sums.solved(k + 1) for k in range(len(ratios))]
    k = int(np.argmax([f[0] for f in found]))
    loglik, beta, cov, s2 = found[k]
    return Fit(sums.cells, beta, cov, s2, ratios[k] * s2, loglik, int(sums.rows), int(sums.subjects[0]))


def _here(table: pd.DataFrame) -> Fit:
    """From all sums of a variable, held on the driver: the best of the first grid, then the root of the slope next to it."""
    own = _Table(table)
    n = own.sizes

    def at(ratios: Sequence[float]) -> _Sums:
        r = np.asarray(ratios)[:, None]
        return own.weighted(np.vstack([np.ones_like(n), r / (1 + r * n)]), np.vstack([np.zeros_like(n), np.log1p(r * n)]), own.rows)

    def slope(g: float) -> float:
        """Of the likelihood in the ratio; residual sums of squares fall by the squares of subjects' summed residuals over (1 + ratio * n)^2."""
        ratio = math.exp(g)
        _, beta, _, s2 = at([ratio]).solved(1)
        w = 1 / (1 + ratio * n)
        summed = own.y2 - 2 * own.cy @ beta + np.einsum("kij,i,j->k", own.cc, beta, beta)
        return float(-0.5 * (own.subjects * n) @ w + 0.5 * (w * w) @ summed / s2)

    tried = at(np.exp(FIRST_GRID))
    best = int(np.argmax([tried.solved(k + 1)[0] for k in range(len(FIRST_GRID))]))
    lo, hi = FIRST_GRID[max(0, best - 1)], FIRST_GRID[min(len(FIRST_GRID) - 1, best + 1)]
    for _ in range(60):
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if slope(middle) > 0 else (lo, middle)
    ratios = [0.0, math.exp((lo + hi) / 2)]
    return _fit(at(ratios), ratios)


def _there(sums: DataFrame, values: Sequence[str]) -> dict[str, Fit]:
    """With sums over sizes in Spark: one aggregation for a grid of ratios of all variables; each grid spans the two steps around the
    best ratio of the one before, until steps are under 1e-9."""
    spark = sums.sparkSession
    grids = {v: FIRST_GRID for v in values}
    totals = {r.dv: r.rows for r in sums.groupBy("dv").agg(F.sum("c").alias("rows")).collect()}
    fits: dict[str, Fit] = {}
    while True:
        tried = [(v, k, float(r)) for v, g in grids.items() if v in totals for k, r in enumerate([math.inf, 0.0, *np.exp(g)])]
        weighted = sums.join(F.broadcast(spark.createDataFrame(tried, "dv string, k int, ratio double")), "dv")  # a grid for each variable
        ratio, n = F.col("ratio"), F.col("n")
        weight = F.when(ratio == math.inf, 1.0).otherwise(ratio / (1 + ratio * n))
        log = F.when(ratio == math.inf, 0.0).otherwise(F.log1p(ratio * n))
        added = weighted.groupBy("dv", "k", "a", "b").agg(*(F.sum(F.col(name) * weight).alias(name) for name in _SUMS), F.sum(F.col("subjects") * log).alias("log")).toPandas()
        for v, table in added.groupby("dv"):
            g = grids[v]
            own = _Table(table.assign(n=table["k"]))  # weight functions take the place of sizes
            joined = own.weighted(np.eye(len(g) + 2), np.zeros((len(g) + 2, len(g) + 2)), totals[v])
            joined.log = table[table["a"].isna()].sort_values("k")["log"].to_numpy(float)
            fits[v] = _fit(joined, [0.0, *np.exp(g)])
            best = int(np.argmax([joined.solved(k + 2)[0] for k in range(len(g))]))
            grids[v] = np.linspace(g[max(0, best - 1)], g[min(len(g) - 1, best + 1)], GRID)
        if max((g[-1] - g[0] for g in grids.values()), default=0.0) < 1e-9:
            return fits


def fits(rows: DataFrame, values: Sequence[str], condition: str = "task", time: str = "t_id", most: int = MOST_NUMBERS) -> dict[str, Fit]:
    """A model for each variable, from one aggregation over all of them; variables without a row that counts have none."""
    sums = cell_sums(rows, values, condition, time)
    most_rows = most // len(sums.columns)
    table = sums.limit(most_rows + 1).toPandas()
    if len(table) > most_rows:
        return _there(checkpoint(sums), values)
    return {v: _here(own.reset_index(drop=True)) for v, own in table.groupby("dv")}


def fit(rows: DataFrame, value: str, condition: str = "task", time: str = "t_id") -> Fit:
    return fits(rows, [value], condition, time)[value]


def prepared(rows: DataFrame, values: Sequence[str], excluded: Sequence[str] = (), condition: str = "task", time: str = "t_id") -> DataFrame:
    """Subject, condition, time and those values that are there, without subjects whose id begins with an excluded prefix."""
    keep = rows
    for prefix in excluded:
        keep = keep.where(~F.startswith(F.col(SUBJECT).cast("string"), F.lit(prefix)) | F.col(SUBJECT).isNull())
    return keep.select(SUBJECT, condition, time, *(v for v in values if v in rows.columns))


#: The result tables of a study, in the order in which they are told.
TABLES = ("model_fit", "fixed_effects", "emmeans_condition", "emmeans_time", "pairs_condition", "pairs_time", "condition_by_time", "time_by_condition", "type3")


def all_tables(rows: DataFrame, values: Sequence[str], excluded: Sequence[str] = (), condition: str = "task", time: str = "t_id") -> dict[str, pd.DataFrame]:
    """The nine result tables over all dependent variables (column dv); variables that the table lacks are skipped."""
    used = prepared(rows, values, excluded, condition, time)
    parts: dict[str, list[pd.DataFrame]] = {t: [] for t in TABLES}
    there = [v for v in values if v in used.columns]
    found = fits(used, there, condition, time) if there else {}
    for value in (v for v in there if v in found):
        one = found[value]
        (by_condition, condition_pairs), (by_time, time_pairs) = one.marginal("condition"), one.marginal("time")
        results = (one.table(), one.effects(), by_condition, by_time, condition_pairs, time_pairs, one.simple("condition"), one.simple("time"), one.wald())
        for name, table in zip(TABLES, results, strict=True):
            parts[name].append(table.assign(dv=value))
    return {name: pd.concat(tables, ignore_index=True) if tables else pd.DataFrame() for name, tables in parts.items()}
