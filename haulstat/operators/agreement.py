"""Rater agreement from counts per unit: no rater pair is ever formed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unit_counts(ratings: DataFrame, unit: list[str], value: str, scale: list) -> DataFrame:
    """One row per unit: how many readings gave each value (``n0``.. ), NULL readings left out."""
    known = ratings.where(F.col(value).isin(*scale))
    counts = [F.count_if(F.col(value) == v).alias(f"n{i}") for i, v in enumerate(scale)]
    return known.groupBy(*unit).agg(F.count("*").alias("m"), *counts)


def coincidences(counts: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    """Coincidence matrix entries ``o_i_j`` summed over the units with two or more readings."""
    usable = counts.where("m >= 2")
    cells = []
    for i in range(k):
        for j in range(k):
            pairs = F.col(f"n{i}") * (F.col(f"n{j}") - (1 if i == j else 0))
            cells.append(F.sum(pairs / (F.col("m") - 1)).alias(f"o_{i}_{j}"))
    return usable.groupBy(*by).agg(F.count("*").alias("units"), F.sum("m").alias("readings"), *cells)


def alpha(k: int, metric: str) -> Column:
    """Krippendorff's alpha over a coincidence row; NULL when every reading is the same value."""
    o = [[F.col(f"o_{i}_{j}") for j in range(k)] for i in range(k)]
    margin = [sum(o[i][1:], o[i][0]) for i in range(k)]
    n = sum(margin[1:], margin[0])

    def delta(i: int, j: int) -> Column:
        if metric == "nominal":
            return F.lit(0.0 if i == j else 1.0)
        if metric == "interval":
            return F.lit(float((i - j) ** 2))
        lo, hi = min(i, j), max(i, j)
        run = sum(margin[lo + 1:hi + 1], margin[lo]) - (margin[lo] + margin[hi]) / 2
        return run * run

    cells = [(i, j) for i in range(k) for j in range(k) if i != j]
    observed = sum((o[i][j] * delta(i, j) for i, j in cells[1:]), o[cells[0][0]][cells[0][1]] * delta(*cells[0])) / n
    expected = sum((margin[i] * margin[j] * delta(i, j) for i, j in cells[1:]),
                   margin[cells[0][0]] * margin[cells[0][1]] * delta(*cells[0])) / (n * (n - 1))
    return F.when((n < 2) | (expected == 0), None).otherwise(1 - observed / expected)


def percent_agreement(k: int) -> Column:
    """Share of reading pairs of a unit that gave the same value (aggregate over units)."""
    same = sum((F.col(f"n{i}") * (F.col(f"n{i}") - 1) for i in range(1, k)), F.col("n0") * (F.col("n0") - 1))
    total = F.sum(F.col("m") * (F.col("m") - 1))
    return F.when(total > 0, F.sum(same) / total)


def lower_median_index(k: int) -> Column:
    """Index of the lower middle reading from counts per value."""
    total = sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0"))
    target, upto, out = F.floor((total - 1) / 2), F.lit(0), None
    for i in range(k):
        upto = upto + F.col(f"n{i}")
        out = F.when(upto > target, i) if out is None else out.when(upto > target, i)
    return F.when(total > 0, out)


def majority_index(k: int) -> Column:
    """Index of the value more than half of the readings gave, else the lower middle one."""
    total = sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0"))
    out = None
    for i in range(k):
        hit = F.col(f"n{i}") * 2 > total
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out.otherwise(lower_median_index(k))


def confusion(counts: DataFrame, k: int) -> DataFrame:
    """Counts of unordered reading pairs (a <= b) within units."""
    pairs = [F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"),
                      (F.col(f"n{i}") * (F.col(f"n{i}") - 1) / 2 if i == j else F.col(f"n{i}") * F.col(f"n{j}")).cast("bigint").alias("pairs"))
             for i in range(k) for j in range(i, k)]
    return counts.select(F.explode(F.array(*pairs)).alias("c")).groupBy("c.a", "c.b").agg(F.sum("c.pairs").alias("pairs")).where("pairs > 0")


def leave_one_out(ratings: DataFrame, unit: list[str], value: str, seq: str, k: int) -> DataFrame:
    """How often a held-out reading equals, or is within one of, the majority of the rest.

    All readings of one value in a unit see the same rest, except the first of
    them, whose removal also moves the first-seen tie rule. So a unit needs its
    counts and the first two positions per value, however many readings it has.
    """
    counts = unit_counts(ratings, unit, value, list(range(k)))
    early = (ratings.where(F.col(value).between(0, k - 1))
             .withColumn("_p", F.row_number().over(W.partitionBy(*unit, value).orderBy(seq))).where("_p <= 2"))
    firsts = early.groupBy(*unit).agg(*[F.min(F.when((F.col(value) == i) & (F.col("_p") == p), F.col(seq))).alias(f"f{i}_{p}")
                                        for i in range(k) for p in (1, 2)])
    df = counts.where("m >= 2").join(firsts, unit)
    cases = []
    for held in range(k):
        for first in (True, False):
            rest = []
            for v in range(k):
                left = F.col(f"n{v}") - (1 if v == held else 0)
                seen = F.col(f"f{v}_2") if (v == held and first) else F.col(f"f{v}_1")
                rest.append(F.when(left > 0, F.struct(left.alias("n"), (-seen).alias("s"), F.lit(v).alias("v"))))
            top = F.array_max(F.filter(F.array(*rest), lambda r: r.isNotNull()))["v"]
            weight = F.when(F.col(f"n{held}") > 0, F.lit(1) if first else F.col(f"n{held}") - 1).otherwise(0)
            cases.append(F.struct(weight.alias("w"), (top == held).cast("int").alias("exact"), (F.abs(top - held) <= 1).cast("int").alias("near")))
    spread = df.select(F.explode(F.array(*cases)).alias("c")).where("c.w > 0")
    return spread.agg(F.sum("c.w").alias("n"), (F.sum(F.col("c.w") * F.col("c.exact")) / F.sum("c.w")).alias("exact"),
                      (F.sum(F.col("c.w") * F.col("c.near")) / F.sum("c.w")).alias("within_one"))
