import numpy as np
import pandas as pd
from haulstat.operators import regression as G
from haulstat.operators import replicas as X
from pyspark.sql import functions as F


def scene(spark, far=0.0):
    """Rows of three makes in two folds, and for each make held out a line by fold."""
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({"fold": rng.integers(0, 2, n), "make": rng.choice(["a", "b", "c"], n), "x": rng.normal(size=n), "np_value": rng.normal(5, 1, n), "np_missing": (rng.random(n) < 0.3).astype(float)})
    pdf["y"] = 3 * pdf.x + rng.normal(size=n) + far * (rng.random(n) < 0.1)
    design = G.Design(["x", "np_value", "np_missing"], {"make": ["a", "b", "c"]})
    fits = []
    for held in "abc":
        for fold in (0, 1):
            fits.append(({"held": held, "fold": fold}, G.Fit(design.columns, rng.normal(size=6), np.zeros(6), np.ones(6), float(rng.normal()))))
    fills = {(h,): float(rng.normal()) for h in "abc"}
    lines = X.replicas(fits, design, {"make": ["a", "b", "c"]}, ["held"], "make", ["a", "b", "c"], lambda make, tag: make != tag[0], fills)
    want = {}
    for held in "abc":
        parts = []
        for tag, fit in fits:
            if tag["held"] == held:
                mine = pdf[(pdf.fold == tag["fold"]) & (pdf.make != held)]
                value = np.where(mine.np_missing == 1, fills[held,], mine.np_value)
                dummies = [(mine.make == m).to_numpy(float) for m in "abc"]
                parts.append(mine.y - (np.column_stack([mine.x, value, mine.np_missing, *dummies]) @ fit.coef + fit.intercept))
        want[held] = np.concatenate(parts)
    return spark.createDataFrame(pdf).repartition(4), design.dense, lines, want


def test_percentiles_of_every_replica(spark):
    for far in (0.0, 1e4):  # some residuals beyond a task's window
        df, xs, lines, want = scene(spark, far)
        exact = {r.held: r for r in X.exact_percentiles(df, lines, xs, [0.1, 0.5, 0.95], ["lo", "mid", "hi"]).collect()}
        kept = {r.held: r for r in X.rounded_percentiles(df, lines, xs, [0.1, 0.95], ["lo", "hi"]).collect()}
        assert set(exact) == set(kept) == set("abc")
        for held, resid in want.items():
            assert np.allclose([exact[held].lo, exact[held].mid, exact[held].hi], np.quantile(resid, [0.1, 0.5, 0.95]), rtol=0, atol=1e-9)
            assert np.allclose([kept[held].lo, kept[held].hi], np.quantile(np.round(resid, 4), [0.1, 0.95]), rtol=0, atol=1e-7)


def test_equal_residuals_are_counted_once(spark):
    df, xs, lines, _ = scene(spark)
    same = df.withColumns({"x": F.lit(1.0), "np_missing": F.lit(1.0), "y": F.lit(2.0)})
    got = X.exact_percentiles(same, lines, xs, [0.0, 1.0], ["lo", "hi"]).collect()
    assert len(got) == 3 and all(r.lo <= r.hi for r in got)


def test_covered_counts_the_rows_of_a_side(spark):
    df, xs, lines, want = scene(spark)
    got = {r.held: r for r in X.covered(df, lines, xs, {(h,): [(-1.0, 1.0), (0.0, 2.5)] for h in "abc"}).collect()}
    for held, resid in want.items():
        assert (got[held].n, got[held].hits_0, got[held].hits_1) == (len(resid), (abs(resid) <= 1).sum(), ((resid >= 0) & (resid <= 2.5)).sum())


def test_the_shuffle_does_not_hold_a_row_for_each_replica(spark):
    df, xs, lines, _ = scene(spark)
    wide = df.select("fold", "make", "np_value", "np_missing", F.round("x", 1).alias("x"), F.lit(0.0).alias("y")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("i").coalesce(2)
    slots = X.histograms(wide, lines, xs).agg(F.count("*").alias("slots"), F.sum("_c").alias("residuals")).first()
    assert slots.residuals == 900 * 20 * 2 and slots.slots <= 900 * 2
