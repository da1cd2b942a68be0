"""Ridge fits from additive moments: one scan, then every fold, hold-out and ablation is a sum of cells.

A cell is a group of rows that share the categorical columns (fold, market,
make, ...). Per cell Spark sums n, x, x*x', x*y, y, y*y of the few dense
columns. Dummy columns are constant inside a cell, so the full design's moment
matrix, of any union of cells, follows from those sums on the driver, where
only (columns x columns) matrices are handled.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_table

CELL_LIMIT = 500_000  # cells come to the driver; their number is checked first


def moment_cells(df: DataFrame, keys: list[str], xs: list[str], y: str, shifts: dict[str, float] | None = None) -> DataFrame:
    """Sums of 1, x, x*x', x*y, y, y*y per cell, with optional shifts against cancellation."""
    moved = {c: F.col(c) - F.lit(float((shifts or {}).get(c, 0.0))) for c in [*xs, y]}
    sums = [F.count("*").alias("n"), F.sum(moved[y]).alias("s_y"), F.sum(moved[y] * moved[y]).alias("s_yy")]
    for i, a in enumerate(xs):
        sums += [F.sum(moved[a]).alias(f"s_{a}"), F.sum(moved[a] * moved[y]).alias(f"s_{a}_y")]
        sums += [F.sum(moved[a] * moved[b]).alias(f"s_{a}_{b}") for b in xs[i:]]
    return df.groupBy(*keys).agg(*sums)


def to_driver(cells: DataFrame) -> list[dict]:
    """Bring the cells to the driver after checking how many there are."""
    rows = cells.limit(CELL_LIMIT + 1).collect()
    if len(rows) > CELL_LIMIT:
        raise ValueError("too many cells: fold rare categories into 'other' first")
    return [r.asDict() for r in rows]


@dataclass
class Design:
    """Dense columns, and categorical columns with the levels that get a dummy."""
    dense: list[str]
    levels: dict[str, list] = field(default_factory=dict)
    shifts: dict[str, float] = field(default_factory=dict)
    target: str = "y"

    @property
    def columns(self) -> list[str]:
        return self.dense + [f"{c}_{v}" for c, vs in self.levels.items() for v in vs]

    def moments(self, rows: list[dict], kind=float) -> np.ndarray:
        """Moment matrix over [1, columns..., target] of a union of cells, added up in numbers of ``kind``."""
        p, q = len(self.dense), sum(len(v) for v in self.levels.values())
        total = np.zeros((p + q + 2, p + q + 2), kind)
        for r in rows:
            flags = np.array([1.0 if r[c] == v else 0.0 for c, vs in self.levels.items() for v in vs])
            sx = np.array([r[f"s_{a}"] for a in self.dense])
            sxy = np.array([r[f"s_{a}_y"] for a in self.dense])
            sxx = np.zeros((p, p))
            for i, a in enumerate(self.dense):
                for j in range(i, p):
                    sxx[i, j] = sxx[j, i] = r[f"s_{a}_{self.dense[j]}"]
            one = np.concatenate([[r["n"]], sx, r["n"] * flags, [r["s_y"]]])
            total[0, :] += one
            total[1:, 0] += one[1:]
            total[1:p + 1, 1:p + 1] += sxx
            total[1:p + 1, p + 1:-1] += np.outer(sx, flags)
            total[p + 1:-1, 1:p + 1] += np.outer(flags, sx)
            total[p + 1:-1, p + 1:-1] += r["n"] * np.outer(flags, flags)
            total[1:p + 1, -1] += sxy
            total[-1, 1:p + 1] += sxy
            total[p + 1:-1, -1] += r["s_y"] * flags
            total[-1, p + 1:-1] += r["s_y"] * flags
            total[-1, -1] += r["s_yy"]
        return total


@dataclass
class Fit:
    columns: list[str]
    coef: np.ndarray       # on standardised columns
    mean: np.ndarray       # of the shifted columns
    scale: np.ndarray
    intercept: float

    @property
    def slopes(self) -> np.ndarray:
        return self.coef / self.scale

    @property
    def constant(self) -> float:
        return float(self.intercept - self.slopes @ self.mean)


def impute_linear(moments: np.ndarray, value: int, missing: int, fill: float) -> np.ndarray:
    """Moments after replacing a zero-filled column by ``value + fill * missing``.

    Mean imputation is linear in (value, missing flag), so it needs no rescan.
    """
    change = np.eye(len(moments), dtype=moments.dtype)
    change[missing, value] = fill
    return change.T @ moments @ change


def fit(moments: np.ndarray, columns: list[str], alpha: float = 1.0, keep: list[str] | None = None) -> Fit:
    """Ridge on standardised columns (population sd, zero sd counts as one), free intercept.

    Moments in ``np.longdouble`` are centred and solved in it: where dummies add up to a constant, only the penalty
    holds their common part, and doubles lose digits of it as the rows grow.
    """
    use = [i for i, c in enumerate(columns) if keep is None or c in keep]
    at = [i + 1 for i in use]
    n = moments[0, 0]
    mean, y_mean = moments[0, at] / n, moments[0, -1] / n
    cov = moments[np.ix_(at, at)] - n * np.outer(mean, mean)
    var = np.maximum(np.diag(cov) / n, 0.0)
    scale = np.where(var <= 1e-12, 1.0, np.sqrt(np.maximum(var, 1e-300)))
    cross = (moments[at, -1] - n * mean * y_mean) / scale
    gram = cov / np.outer(scale, scale)
    coef = solved(gram + alpha * np.eye(len(at)), cross)
    return Fit([columns[i] for i in use], *[v.astype(float) for v in (coef, mean, scale)], float(y_mean))


def solved(system: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution in the precision of ``system``: what a double solution leaves is solved for again."""
    rough = system.astype(float)
    out = np.linalg.solve(rough, right.astype(float))
    for _ in range(0 if system.dtype == float else 3):
        out = out + np.linalg.solve(rough, (right - system @ out).astype(float))
    return out


def squared_error(moments: np.ndarray, columns: list[str], model: Fit) -> float:
    """Residual sum of squares of ``model`` on the rows behind ``moments``: no rescan."""
    b = np.zeros(len(moments))
    b[0] = -model.constant
    for c, s in zip(model.columns, model.slopes):
        b[columns.index(c) + 1] = -s
    b[-1] = 1.0
    return float(b @ moments @ b)


def total_squares(moments: np.ndarray) -> float:
    return float(moments[-1, -1] - moments[0, -1] ** 2 / moments[0, 0])


def r_squared(folds: dict, design: Design, alpha: float = 1.0, keep: list[str] | None = None, score=None, prepare=lambda m: m) -> dict:
    """Grouped out-of-fold R2 and residual sd from cells alone.

    ``folds`` maps fold -> its cells; fold k is fitted on all the others.
    ``score`` picks the cells that count (all by default).
    """
    per_fold = {k: prepare(design.moments(rows)) for k, rows in folds.items()}
    scored = {k: prepare(design.moments([r for r in rows if score is None or score(r)])) for k, rows in folds.items()}
    whole, tested = sum(per_fold.values()), sum(scored.values())
    left = sum(squared_error(scored[k], design.columns, fit(whole - per_fold[k], design.columns, alpha, keep))
               for k in per_fold)
    n, spread = tested[0, 0], total_squares(tested)
    return {"n": int(round(n)), "r2": 1 - left / spread if spread > 0 else None, "sse": left, "sst": spread}


def line_table(spark: SparkSession, fits: list[tuple[dict, Fit]], design: Design, categories: dict[str, list]) -> DataFrame:
    """Every fit as rows keyed by its tags and the categorical values.

    A row carries the constant (intercept plus the dummies' effects, shifts
    undone) and the slopes of the dense columns, so scoring is one equi-join
    with a small table and a handful of multiplications.
    """
    names, rows = line_rows(fits, design, categories)
    return small_table(spark, rows, names)


def line_rows(fits: list[tuple[dict, Fit]], design: Design, categories: dict[str, list]) -> tuple[list[str], list[tuple]]:
    """(names, rows) of ``line_table``."""
    rows = []
    for tags, model in fits:
        slope = dict(zip(model.columns, model.slopes))
        dense = [float(slope.get(c, 0.0)) for c in design.dense]
        base = model.constant + design.shifts.get(design.target, 0.0) - sum(
            s * design.shifts.get(c, 0.0) for s, c in zip(dense, design.dense))
        combos = [()]
        for c in categories:
            combos = [(*done, v) for done in combos for v in categories[c]]
        for combo in combos:
            const = base + sum(slope.get(f"{c}_{v}", 0.0) for c, v in zip(categories, combo))
            rows.append((*tags.values(), *combo, float(const), *dense))
    return [*fits[0][0], *categories, "_const", *[f"_b_{c}" for c in design.dense]], rows


def predicted(design: Design) -> Column:
    total = F.col("_const")
    for c in design.dense:
        total = total + F.col(f"_b_{c}") * F.col(c)
    return total


def score(df: DataFrame, lines: DataFrame, on: list[str], design: Design, name: str = "predicted") -> DataFrame:
    drop = ["_const"] + [f"_b_{c}" for c in design.dense]
    return df.join(lines, on).withColumn(name, predicted(design)).drop(*drop)


def residual_percentiles(residuals: DataFrame, by: list[str], value: str, probs: list[float], names: list[str],
                         step: float = 1e-4) -> DataFrame:
    """Interpolated percentiles of residuals kept to ``step`` (0.01 % of a price).

    The rounded values combine on the map side, so thousands of replicas
    shuffle only their histograms.
    """
    from .ranking import exact_percentiles
    rounded = residuals.withColumn(value, F.round(F.col(value) / F.lit(step)) * F.lit(step))
    return exact_percentiles(rounded, by, value, probs, names)


def widening_needed(required: DataFrame, by: list[str], level: float, step: float = 0.05, top: float = 4.0) -> DataFrame:
    """Smallest grid factor in [1, top] at which a ``level`` share of the rows is covered.

    ``required`` holds each row's own needed factor. Rounding up to the grid keeps the order, so the
    rows are counted by grid factor and the wanted rank is looked up among the counts.
    """
    from pyspark.sql import Window as W
    grid = 1.0 + F.ceil((F.col("needed") - 1.0 - 1e-9) / step) * step
    factor = F.round(F.least(F.lit(top), F.greatest(F.lit(1.0), grid)), 2)
    counts = required.groupBy(*by, factor.alias("widening_needed")).agg(F.count("*").alias("_c"))
    group = W.partitionBy(*by)
    counts = (counts.withColumn("_upto", F.sum("_c").over(group.orderBy("widening_needed")))
              .withColumn("_n", F.sum("_c").over(group)))
    at_level = F.ceil(F.col("_n") * level - 1e-9)
    reached = (F.col("_upto") >= at_level) & (F.col("_upto") - F.col("_c") < at_level)
    return counts.where(reached).select(*by, "widening_needed")
