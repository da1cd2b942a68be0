"""Whole makes held out: every quantity that prices a held-out make is fitted without a row of it.

Moments are summed once by (make, fold). What a hold-out needs, its vocabulary, hedonic fit,
retention curve and their spreads, is the total minus the make's own cells; only the two band
edges, which are percentiles, read the remaining rows again.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import listings as L
from ..session import cut_lineage, small_table, spread_out
from . import prices as P
from . import ranking as R
from . import regression as G
from . import replicas as X

HEDONIC, CURVE = ["log1p_age", "log_km", "euro6"], ["log1p_age", "log_km"]
SHIFTS = {"log1p_age": 2.0, "log_km": 12.0, "y": 10.0}
LEAST_CURVE = 20  # rows with a published new price that a retention curve needs


@dataclass
class Holdout:
    """What the rows of the other makes say: fits by fold and over all of them, and their out-of-fold spread."""

    make: str
    makes: list[str]
    hedonic: G.Fit
    by_fold: dict[int, G.Fit]
    spread: float
    curve: G.Fit | None
    curve_spread: float | None


def out_of_fold(folds: dict[int, np.ndarray], columns: list[str]) -> tuple[G.Fit, dict[int, G.Fit], float]:
    """(fit of all, fit without each fold, standard deviation of the out-of-fold residuals), from moments alone."""
    whole = sum(folds.values())
    fits = {k: G.fit(whole - m, columns) for k, m in folds.items() if (whole - m)[0, 0] > 0}
    n, total, squares = 0.0, 0.0, 0.0
    for k, fit in fits.items():
        line = np.zeros(len(whole))
        line[0], line[-1] = -fit.constant, 1.0
        for c, s in zip(fit.columns, fit.slopes):
            line[columns.index(c) + 1] = -s
        n += folds[k][0, 0]
        total += float(line @ folds[k][0])
        squares += float(line @ folds[k] @ line)
    return G.fit(whole, columns), fits, float(np.sqrt(max(squares / n - (total / n) ** 2, 0.0))) if n else 0.0


def make_fits(df: DataFrame, min_held: int = 3, min_rest: int = 8, min_make: int = 3) -> tuple[G.Design, list[Holdout]]:
    """The design and a ``Holdout`` for each make with at least ``min_held`` rows beside ``min_rest`` of others.

    ``df`` has brand, fold, y, the hedonic columns and log_new_price (null without one). A make with
    fewer than ``min_make`` rows is 'other', as is a held-out make when it is priced.
    """
    rows = G.to_driver(G.moment_cells(df, ["brand", "fold"], HEDONIC, "y", SHIFTS))
    priced = df.where("log_new_price is not null").withColumn("kept_value", F.col("y") - F.col("log_new_price"))
    curve_rows = G.to_driver(G.moment_cells(priced, ["brand", "fold"], CURVE, "kept_value", SHIFTS))
    sizes: dict[str, int] = {}
    for r in rows:
        sizes[r["brand"]] = sizes.get(r["brand"], 0) + r["n"]
    makes = sorted(b for b, n in sizes.items() if n >= min_make)
    design = G.Design(HEDONIC, {"brand_used": [*makes, "other"]}, SHIFTS)
    curve = G.Design(CURVE, {}, SHIFTS, "kept_value")
    for r in rows:
        r["brand_used"] = r["brand"] if r["brand"] in makes else "other"
        r["m"] = design.moments([r])
    for r in curve_rows:
        r["m"] = curve.moments([r])

    def totals(cells):
        folds: dict[int, np.ndarray] = {}
        for r in cells:
            folds[r["fold"]] = folds.get(r["fold"], 0) + r["m"]
        return folds

    whole, whole_curve = totals(rows), totals(curve_rows)
    out = []
    for make in sorted(sizes):
        if sizes[make] < min_held or sum(sizes.values()) - sizes[make] < min_rest:
            continue
        rest = subtract(whole, totals([r for r in rows if r["brand"] == make]))
        hedonic, by_fold, spread = out_of_fold(rest, design.columns)
        left = subtract(whole_curve, totals([r for r in curve_rows if r["brand"] == make]))
        fitted = sum(m[0, 0] for m in left.values()) >= LEAST_CURVE
        ret, _, ret_spread = out_of_fold(left, curve.columns) if fitted else (None, None, None)
        out.append(Holdout(make, sorted(set(sizes) - {make}), hedonic, by_fold, spread, ret, ret_spread))
    return design, out


def subtract(whole: dict[int, np.ndarray], part: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    left = {k: m - part[k] if k in part else m for k, m in whole.items()}
    return {k: m for k, m in left.items() if m[0, 0] > 0.5}


def price_unknown_makes(df: DataFrame, level: float = 0.8, widening: float = P.UNKNOWN_BRAND_WIDENING, **options) -> DataFrame:
    """(held, y, lo, hi, plain, anchored, factor, weight): every row of every held-out make priced as an unknown, twice.

    ``plain`` is the hedonic estimate, whose band is widened by ``widening``; ``anchored`` blends in the published new price through the
    retention curve where the row has one, with its own band ``factor``. ``lo`` and ``hi`` are the band edges of the
    other makes' out-of-fold residuals. ``df`` also has new_price_source. Makes that are too few for a hold-out give no rows.
    """
    spark = df.sparkSession
    columns = ["brand", "fold", "y", *HEDONIC, "log_new_price", "new_price_source"]
    df = cut_lineage(df.select(*columns))
    design, fits = make_fits(df, **options)
    if not fits:
        empty = "held string, y double, lo double, hi double, plain double, anchored double, factor double, weight double"
        return spark.createDataFrame([], empty)
    known = design.levels["brand_used"]
    used = F.when(F.col("brand").isin([b for b in known if b != "other"]), F.col("brand")).otherwise("other")
    rows = spread_out(df).withColumn("brand_used", used)
    inner = [({"held": h.make, "fold": int(k)}, f) for h in fits for k, f in h.by_fold.items()]
    brands = sorted({b for h in fits for b in (h.make, *h.makes)})
    lines = X.replicas(inner, design, {"brand_used": known}, ["held"], "brand", brands, lambda brand, tag: brand != tag[0])
    tail = (1 - level) / 2
    bands = X.exact_percentiles(rows, lines, HEDONIC, [tail, 1 - tail], ["lo", "hi"])
    facts = []
    for h in fits:
        line = (np.zeros(2), 0.0) if h.curve is None else (h.curve.slopes, h.curve.constant - sum(s * SHIFTS[c] for s, c in zip(h.curve.slopes, CURVE)))
        facts.append((h.make, float(h.spread), h.curve is not None, float(line[0][0]), float(line[0][1]), float(line[1]), float(h.curve_spread or 0.0)))
    facts = small_table(spark, facts, ["held", "sd", "has_curve", "k_age", "k_km", "k_const", "k_sd"])
    outer = G.line_table(spark, [({"held": h.make}, h.hedonic) for h in fits], design, {"brand_used": ["other"]})
    test = G.score(rows.withColumn("held", F.col("brand")).withColumn("brand_used", F.lit("other")), outer, ["held", "brand_used"], design, "plain")
    test = test.join(facts, "held").join(bands, "held")
    there = F.col("has_curve") & F.col("log_new_price").isNotNull()
    other = F.col("log_new_price") + F.col("k_const") + F.col("k_age") * F.col("log1p_age") + F.col("k_km") * F.col("log_km")
    source = F.coalesce(F.element_at(L.alias_map(P.SOURCE_WIDENING), F.col("new_price_source")), F.lit(1.35))
    mu, sd, weight = P.blend(F.col("plain"), F.col("sd") * widening, other, F.col("k_sd") * source)
    factor = F.when(there, F.greatest(F.lit(1.0), sd / F.col("sd"))).otherwise(F.lit(float(widening)))
    return test.select("held", "y", "lo", "hi", "plain", F.when(there, mu).otherwise(F.col("plain")).alias("anchored"), factor.alias("factor"), F.when(there, weight).alias("weight"))


def holdout_report(priced: DataFrame, widening: float = P.UNKNOWN_BRAND_WIDENING) -> DataFrame:
    """A row for each held-out make: coverage, median error and band factor of both routes, and the anchor's mean weight."""
    y, f = F.col("y"), F.col("factor")
    plain = y.between(F.col("plain") + F.col("lo") * widening, F.col("plain") + F.col("hi") * widening)
    anchored = y.between(F.col("anchored") + F.col("lo") * f, F.col("anchored") + F.col("hi") * f)
    errors = priced.withColumns({"ape_plain": F.abs(F.expm1(F.col("plain") - y)) * 100, "ape_anchored": F.abs(F.expm1(F.col("anchored") - y)) * 100})
    medians = [R.exact_percentiles(errors, ["held"], f"ape_{k}", [0.5], [f"median_{k}"]).drop("n") for k in ("plain", "anchored")]
    out = priced.groupBy("held").agg(F.count("*").alias("n_held_out"), F.avg(plain.cast("double")).alias("coverage_widened_only"), F.avg(anchored.cast("double")).alias("coverage_with_anchor"),
                                     F.avg("factor").alias("band_factor_with_anchor"), F.coalesce(F.avg("weight"), F.lit(0.0)).alias("mean_anchor_weight"))
    return out.join(medians[0], "held").join(medians[1], "held")
