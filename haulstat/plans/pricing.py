"""Price-model queries: frame, moments, folds, calibration, hold-outs, estimates."""
from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import fold_of, uniform
from ..functions import listings as L
from ..operators import holdouts as H
from ..operators import neighbours as N
from ..operators import permutations as M
from ..operators import prices as P
from ..operators import ranking as R
from ..operators import regression as G
from ..operators import replicas as X
from ..session import cut_lineage, small_table, spread_out
from .registry import query
from .statements import permuted_sql, ridge_sql

DENSE = ["log1p_age", "log_km", "euro6", "np_value", "np_missing"]
SHIFTS = {"log1p_age": 2.0, "log_km": 12.0, "y": 10.0}
NEW_PRICE_SHIFT = 11.0  # for rows that have one; the others stay at zero until they are imputed
SPLIT_CELLS, CALIBRATION_SPLITS, TEST_SHARE = 200, 40, 25

NEW_PRICE_SQL = """
np AS (SELECT p_brand AS brand, p_type AS model, CASE WHEN p_type = 'PROMO' THEN NULL ELSE max(p_retailprice) * 60 END AS list_price,
  CASE WHEN p_type = 'LARGE' THEN 'trade_press' ELSE 'oem_official' END AS source_type, p_type = 'STANDARD' AND p_brand <> 'Brand#9' AS is_default FROM part GROUP BY p_brand, p_type),
npe AS (SELECT l.*, coalesce(e.list_price, CASE WHEN l.market = 'TR' THEN d.list_price END) AS new_price,
  CASE WHEN e.list_price IS NOT NULL THEN e.source_type WHEN d.list_price IS NOT NULL AND l.market = 'TR' THEN d.source_type END AS new_price_source,
  CASE WHEN e.list_price IS NOT NULL THEN 'exact' WHEN d.list_price IS NOT NULL AND l.market = 'TR' THEN 'default' ELSE 'none' END AS matched_by
 FROM listings l LEFT JOIN np e ON l.market = 'TR' AND e.brand = upper(l.make) AND e.list_price IS NOT NULL AND e.model = CASE WHEN l.model = 'SMALL' THEN 'MEDIUM' ELSE l.model END
 LEFT JOIN np d ON d.brand = upper(l.make) AND d.is_default AND d.list_price IS NOT NULL)"""
# Brands are upper-cased by the normal form, so the reference carries the same spelling.
NEW_PRICE_SQL = NEW_PRICE_SQL.replace("SELECT p_brand AS brand", "SELECT upper(p_brand) AS brand")
FRAME_SQL = NEW_PRICE_SQL + """,
frame AS (SELECT *, upper(make) AS brand, ln(1 + greatest(2026 - year, 0)) AS log1p_age, ln(greatest(km, 1000)) AS log_km, ln(price) AS y,
  CAST(coalesce(nullif(euro_norm, ''), CASE WHEN year >= 2016 THEN 'Euro 6' ELSE 'Euro 5' END) = 'Euro 6' AS DOUBLE) AS euro6,
  ('0x' || substr(md5(market || '|' || upper(make) || '|' || model || '|' || CAST(size_class AS VARCHAR)), 1, 8))::BIGINT % 5 AS fold
 FROM npe WHERE price > 0 AND km IS NOT NULL)"""


def new_prices(t):
    mean = F.max("p_retailprice") * 60
    return t.part.groupBy(F.upper("p_brand").alias("brand"), F.col("p_type").alias("model")).agg(mean.alias("m")).select(
        "brand", "model", F.when(F.col("model") != "PROMO", F.col("m")).alias("list_price"),
        F.when(F.col("model") == "LARGE", "trade_press").otherwise("oem_official").alias("source_type"),
        ((F.col("model") == "STANDARD") & (F.col("brand") != "BRAND#9")).alias("is_default"))


def aliases(t):
    return t.part.select(F.upper("p_brand").alias("brand")).distinct().select(
        "brand", F.lit("SMALL").alias("alias"), F.lit("MEDIUM").alias("canonical"))


def frame(t):
    df = P.new_price_lookup(P.price_frame(t.listings), new_prices(t), aliases(t))
    logp = F.log("new_price")
    return df.withColumns({"log_new_price": logp, "np_value": F.coalesce(logp, F.lit(0.0)),
                           "np_missing": F.when(logp.isNull(), 1.0).otherwise(0.0),
                           "cell": fold_of(F.concat(F.lit("cell|"), F.col("spec_group")), SPLIT_CELLS)})


@query("d04_new_price_lookup", "listings", NEW_PRICE_SQL + " SELECT listing_id, round(new_price, 2) AS new_price, new_price_source, matched_by FROM npe WHERE price > 0 AND km IS NOT NULL")
def new_price_lookup(t):
    return frame(t).select("listing_id", F.round("new_price", 2).alias("new_price"), "new_price_source", "matched_by")


@query("e01_brand_vocabulary", "listings", """
SELECT upper(make) AS brand, count(*) AS n FROM listings WHERE price > 0 AND km IS NOT NULL GROUP BY 1 HAVING count(*) >= 1500 UNION ALL SELECT 'other', 0""")
def vocabulary(t):
    known = P.brand_vocabulary(P.price_frame(t.listings), 1500)
    rest = known.limit(0).agg(F.lit("other").alias("brand"), F.count("*").alias("n"))
    return known.unionByName(rest)


@query("b10_new_price_cell_by_fold", "listings", FRAME_SQL + """,
s AS (SELECT f.fold, avg(ln(g.new_price)) AS m, min(ln(g.new_price)) AS lo, max(ln(g.new_price)) AS hi FROM (SELECT DISTINCT fold FROM frame) f JOIN frame g ON g.fold <> f.fold WHERE g.new_price IS NOT NULL GROUP BY 1)
SELECT listing_id, round(CASE WHEN new_price IS NULL THEN m ELSE greatest(least(ln(new_price), hi), lo) END, 4) AS log_new_price, CAST(new_price IS NULL AS INTEGER) AS missing FROM frame JOIN s USING (fold)""")
def new_price_by_fold(t):
    df = frame(t)
    per = df.groupBy("fold").agg(F.sum("log_new_price").alias("s"), F.count("log_new_price").alias("k"),
                                 F.min("log_new_price").alias("lo"), F.max("log_new_price").alias("hi"))
    rest = per.alias("a").join(per.alias("b"), F.expr("a.fold <> b.fold")).groupBy("a.fold").agg(
        (F.sum("b.s") / F.sum("b.k")).alias("m"), F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi"))
    value, missing = P.new_price_cell(F.col("log_new_price"), F.col("m"), F.col("lo"), F.col("hi"))
    return df.join(rest, "fold").select("listing_id", F.round(value, 4).alias("log_new_price"), missing.cast("int").alias("missing"))


@query("i01_moment_cells", "listings", FRAME_SQL + """
SELECT fold, market, brand, count(*) AS n, round(sum(y - 10), 3) AS s_y, round(sum((y - 10) * (y - 10)), 3) AS s_yy, round(sum(log1p_age - 2), 3) AS s_a, round(sum(log_km - 12), 3) AS s_k,
 round(sum((log1p_age - 2) * (log_km - 12)), 3) AS s_ak, round(sum((log_km - 12) * (y - 10)), 3) AS s_ky FROM frame GROUP BY 1, 2, 3""")
def moment_cells(t):
    cells = G.moment_cells(frame(t), ["fold", "market", "brand"], ["log1p_age", "log_km"], "y", SHIFTS)
    r = lambda c: F.round(c, 3)
    return cells.select(F.col("fold").cast("bigint").alias("fold"), "market", "brand", "n", r("s_y").alias("s_y"), r("s_yy").alias("s_yy"),
                        r("s_log1p_age").alias("s_a"), r("s_log_km").alias("s_k"),
                        r("s_log1p_age_log_km").alias("s_ak"), r("s_log_km_y").alias("s_ky"))


RIDGE_SQL = """
c AS (SELECT fold, count(*) AS n, sum(x1) AS a, sum(x2) AS b, sum(z) AS z, sum(x1 * x1) AS aa, sum(x2 * x2) AS bb, sum(x1 * x2) AS ab, sum(x1 * z) AS az, sum(x2 * z) AS bz FROM d GROUP BY 1),
m AS (SELECT f.fold, sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(z) AS z, sum(aa) AS aa, sum(bb) AS bb, sum(ab) AS ab, sum(az) AS az, sum(bz) AS bz FROM (SELECT fold FROM c UNION ALL SELECT -1) f JOIN c ON c.fold <> f.fold GROUP BY 1),
v AS (SELECT fold, n, a / n AS ma, b / n AS mb, z / n AS mz, sqrt(aa / n - a * a / n / n) AS sa, sqrt(bb / n - b * b / n / n) AS sb,
  ab - a * b / n AS cab, az - a * z / n AS caz, bz - b * z / n AS cbz FROM m),
w AS (SELECT *, cab / sa / sb AS r, caz / sa AS u, cbz / sb AS q, n + 1 AS h FROM v),
fit AS (SELECT *, (h * u - r * q) / (h * h - r * r) AS c1, (h * q - r * u) / (h * h - r * r) AS c2 FROM w),
oof AS (SELECT d.*, z - (mz + (x1 - ma) / sa * c1 + (x2 - mb) / sb * c2) AS resid FROM d JOIN fit USING (fold))"""
RETENTION_SQL = FRAME_SQL + ", d AS (SELECT listing_id, fold, brand, model, log1p_age AS x1, log_km AS x2, ln(price / new_price) AS z, y FROM frame WHERE new_price IS NOT NULL)," + RIDGE_SQL
TWO_COLUMN_SQL = FRAME_SQL + ", d AS (SELECT listing_id, fold, market, brand, log1p_age AS x1, log_km AS x2, y AS z FROM frame)," + RIDGE_SQL


def two_column_fits(df, target, tags=lambda k: {"fold": k}):
    """Every fold's fit (and the full one, fold -1) of a two-column design."""
    design = G.Design(["log1p_age", "log_km"], {}, {**SHIFTS, target: SHIFTS.get(target, 0.0)}, target)
    rows = G.to_driver(G.moment_cells(df, ["fold"], design.dense, target, design.shifts))
    whole = design.moments(rows)
    fits = [({"fold": -1}, G.fit(whole, design.columns))]
    fits += [({"fold": r["fold"]}, G.fit(whole - design.moments([r]), design.columns)) for r in rows]
    return design, fits


@query("i01_ridge_two_columns", "listings", TWO_COLUMN_SQL + " SELECT fold, n, round(c1, 4) AS coef_age, round(c2, 4) AS coef_km, round(ma, 4) AS mean_age, round(sb, 4) AS scale_km, round(mz, 4) AS intercept FROM fit")
def ridge_two_columns(t):
    df = frame(t)
    design, fits = two_column_fits(df, "y")
    per = df.groupBy("fold").agg(F.count("*").alias("n"))
    rows = [(int(tag["fold"]), float(m.coef[0]), float(m.coef[1]), float(m.mean[0] + SHIFTS["log1p_age"]), float(m.scale[1]), float(m.intercept + SHIFTS["y"])) for tag, m in fits]
    table = t.spark.createDataFrame(rows, "fold bigint, coef_age double, coef_km double, mean_age double, scale_km double, intercept double")
    total = R.with_row(table, per.agg(F.sum("n").alias("all_n")), "all_n").join(per.withColumn("fold", F.col("fold").cast("bigint")), "fold", "left")
    r4 = lambda c: F.round(c, 4).alias(c)
    return total.select("fold", (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n"), r4("coef_age"), r4("coef_km"), r4("mean_age"), r4("scale_km"), r4("intercept"))


@query("i02_out_of_fold_metrics", "listings", TWO_COLUMN_SQL + """
SELECT count(*) AS n, round(1 - sum(resid * resid) / (sum(z * z) - sum(z) * sum(z) / count(*)), 4) AS r2, round(avg(abs(exp(resid) - 1)) * 100, 1) AS mae_pct,
 round(quantile_cont(abs(exp(resid) - 1), 0.5) * 100, 1) AS median_ape, round(stddev_pop(resid), 4) AS residual_std FROM oof""")
def out_of_fold(t):
    df = cut_lineage(frame(t).select("fold", "y", "log1p_age", "log_km"))
    design, fits = two_column_fits(df, "y")
    return metrics(out_of_fold_residuals(t, df, design, fits), "y")


def out_of_fold_residuals(t, df, design, fits, target="y"):
    lines = G.line_table(t.spark, [f for f in fits if f[0]["fold"] >= 0], design, {})
    scored = G.score(df, lines.withColumn("fold", F.col("fold").cast("int")), ["fold"], design)
    return scored.withColumn("resid", F.col(target) - F.col("predicted"))


def metrics(scored, target):
    resid = F.col("resid")
    ape = scored.withColumn("ape", F.abs(F.expm1("resid")))
    middle = R.exact_percentiles(ape, [], "ape", [0.5], ["median"])
    y = F.col(target)
    agg = ape.agg(F.count("*").alias("n"),
                  F.round(1 - F.sum(resid * resid) / (F.sum(y * y) - F.sum(y) * F.sum(y) / F.count("*")), 4).alias("r2"),
                  F.round(F.avg("ape") * 100, 1).alias("mae_pct"), F.round(F.stddev_pop("resid"), 4).alias("residual_std"))
    return R.with_row(agg, middle, "median").withColumn("median_ape", F.round(F.col("median") * 100, 1)).drop("median")


@query("i05_retention_curve", "listings", RETENTION_SQL + """
SELECT (SELECT round(c1, 4) FROM fit WHERE fold = -1) AS coef_age, (SELECT round(c2, 4) FROM fit WHERE fold = -1) AS coef_km, count(*) AS n, count(*) >= 20 AS ok,
 round(1 - sum(resid * resid) / (sum(z * z) - sum(z) * sum(z) / count(*)), 4) AS r2, round(quantile_cont(abs(exp(-resid) - 1), 0.5) * 100, 1) AS median_ape, round(stddev_pop(resid), 4) AS residual_std FROM oof""")
def retention_curve(t):
    df = frame(t).where("new_price is not null").withColumn("z", F.log(F.col("price") / F.col("new_price")))
    df = cut_lineage(df.select("fold", "z", "log1p_age", "log_km"))
    design, fits = two_column_fits(df, "z")
    full = fits[0][1]
    scored = out_of_fold_residuals(t, df, design, fits, "z").withColumn("resid", -F.col("resid"))
    out = metrics(scored, "z").drop("mae_pct")
    return out.select(F.round(F.lit(float(full.coef[0])), 4).alias("coef_age"), F.round(F.lit(float(full.coef[1])), 4).alias("coef_km"),
                      "n", (F.col("n") >= 20).alias("ok"), "r2", "median_ape", "residual_std")


# ---- the full design: dense columns, market and make dummies, imputed new price ----

def full_cells(df, keys):
    return G.to_driver(G.moment_cells(df, keys, DENSE, "y", SHIFTS))


def full_design(rows, min_n=5, new_price=True):
    counts: dict = {}
    for r in rows:
        counts[r["brand"]] = counts.get(r["brand"], 0) + r["n"]
    brands = sorted(b for b, n in counts.items() if n >= min_n) + ["other"]
    for r in rows:
        r["brand_used"] = r["brand"] if r["brand"] in brands else "other"
    return G.Design(DENSE, {"market": ["TR", "EU"], "brand_used": brands}, SHIFTS), brands


def imputer(design, whole):
    """Moments with the new price imputed at the mean of the rows that have one."""
    v, m = 1 + DENSE.index("np_value"), 1 + DENSE.index("np_missing")
    known = whole[0, 0] - whole[0, m]
    fill = whole[0, v] / known if known > 0 else 0.0
    return lambda moments: G.impute_linear(moments, v, m, fill), fill


def by_key(rows, key):
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


# Columns of the statement: 1-5 dense, 6 and 7 markets, 8 other makes, 9-34 the makes.
FULL_SQL = FRAME_SQL + """,
priced AS (SELECT *, avg(ln(new_price)) OVER () AS fill, CASE WHEN count(*) OVER (PARTITION BY brand) >= 5 THEN 8 + dense_rank() OVER (ORDER BY brand) ELSE 8 END AS b FROM frame),
d AS (SELECT listing_id, fold, b, log1p_age - 2 AS x1, log_km - 12 AS x2, euro6 AS x3, coalesce(ln(new_price), fill) AS x4, (new_price IS NULL)::DOUBLE AS x5, (market = 'TR')::DOUBLE AS x6, (market = 'EU')::DOUBLE AS x7, y - 10 AS z FROM priced),
long AS (SELECT listing_id, fold, b, unnest([{'i': 0, 'x': 1.0::DOUBLE}, {'i': 1, 'x': x1}, {'i': 2, 'x': x2}, {'i': 3, 'x': x3}, {'i': 4, 'x': x4}, {'i': 5, 'x': x5}, {'i': 6, 'x': x6}, {'i': 7, 'x': x7}, {'i': 999, 'x': z}], recursive := true) FROM d),
pairs AS (SELECT s.fold, s.b, s.i, t.i AS j, sum(s.x * t.x) AS v FROM long s JOIN long t USING (listing_id) GROUP BY ALL),
moments AS (SELECT 'all' AS tag, fold, i, j, sum(v) AS v FROM (SELECT fold, i, j, v FROM pairs UNION ALL SELECT fold, b, j, v FROM pairs WHERE i = 0 UNION ALL SELECT fold, j, b, v FROM pairs WHERE i = 0
  UNION ALL SELECT fold, b, b, v FROM pairs WHERE i = 0 AND j = 0) GROUP BY ALL),
columns AS (SELECT b AS i, CASE WHEN b = 8 THEN 'brand_used_other' ELSE 'brand_used_' || brand END AS feature FROM (SELECT DISTINCT b, CASE WHEN b > 8 THEN brand END AS brand FROM priced) UNION
  SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]), unnest(['log1p_age', 'log_km', 'euro6', 'np_value', 'np_missing', 'market_TR', 'market_EU', 'brand_used_other']))"""
RESIDUAL_SQL = FULL_SQL + "," + ridge_sql("fit", "moments", 34) + """,
resid AS (SELECT l.listing_id, any_value(l.fold) AS fold, sum(l.x * f.b) + any_value(m.b) AS resid FROM long l JOIN fit_beta f ON f.fold = l.fold AND f.i = l.i AND l.i > 0 JOIN fit_beta m ON m.fold = l.fold AND m.i = l.b GROUP BY 1),
constants AS (SELECT fold, b AS c FROM fit_beta WHERE i = 0),
residuals AS (SELECT listing_id, split_part(listing_id, '-', 1) AS vehicle, resid + c AS resid FROM resid JOIN constants USING (fold))"""


@query("i01_ridge_full_design", "listings", "WITH_RECURSIVE " + FULL_SQL + """,
whole AS (SELECT tag, -1 AS fold, i, j, sum(v) AS v FROM moments GROUP BY ALL),""" + ridge_sql("full", "whole", 34, False) + """
SELECT feature, round(coef, 6) AS coef, round(sd, 6) AS scale FROM full_coef JOIN columns USING (i)""")
def ridge_full(t):
    # The new price moves as the other columns do; neither coefficients nor scales show it, and its sums keep their digits.
    moved = F.coalesce(F.col("log_new_price") - F.lit(NEW_PRICE_SHIFT), F.lit(0.0))
    rows = full_cells(frame(t).withColumn("np_value", moved), ["market", "brand"])
    design, _ = full_design(rows)
    whole = design.moments(rows, np.longdouble)
    prepare, _ = imputer(design, whole)
    model = G.fit(prepare(whole), design.columns)
    return t.spark.createDataFrame([(c, round(float(b), 6), round(float(s), 6)) for c, b, s in zip(model.columns, model.coef, model.scale)],
                                   "feature string, coef double, scale double")


def spec_residuals(df):
    """(listing_id, vehicle, market, resid): out-of-fold residuals of the full design, folds of whole spec groups."""
    rows = full_cells(df, ["fold", "market", "brand"])
    design, brands = full_design(rows)
    whole = design.moments(rows)
    prepare, fill = imputer(design, whole)
    fits = [({"fold": int(f)}, G.fit(prepare(whole - design.moments(part)), design.columns)) for f, part in by_key(rows, "fold").items()]
    lines = G.line_table(df.sparkSession, fits, design, {"market": ["TR", "EU", "US"], "brand_used": brands}).withColumn("fold", F.col("fold").cast("int"))
    filled = df.withColumn("np_value", F.when(F.col("np_missing") == 1, F.lit(float(fill))).otherwise(F.col("np_value")))
    filled = filled.withColumn("brand_used", F.when(F.col("brand").isin(brands), F.col("brand")).otherwise("other"))
    scored = G.score(filled, lines, ["fold", "market", "brand_used"], design)
    return scored.select("listing_id", F.split_part("listing_id", F.lit("-"), F.lit(1)).alias("vehicle"), "market", (F.col("y") - F.col("predicted")).alias("resid"))


@query("i13_vehicle_residuals", "listings", "WITH_RECURSIVE " + RESIDUAL_SQL + """
SELECT vehicle, count(*) AS n_listings, round(avg(resid), 6) AS residual FROM residuals GROUP BY 1""")
def vehicle_residuals(t):
    """The residual a vehicle's adverts share: the target of the probes."""
    adverts = cut_lineage(frame(t).select("listing_id", "market", "brand", "fold", *DENSE, "y"))
    return spec_residuals(adverts).groupBy("vehicle").agg(F.count("*").alias("n_listings"), F.round(F.avg("resid"), 6).alias("residual"))


NO_PRICE = ["log1p_age", "log_km", "euro6"]


def r2_of(rows, keep=None, market=None, design=None):
    design = design or full_design(rows)[0]
    prepare, _ = imputer(design, design.moments(rows))
    return G.r_squared(by_key(rows, "fold"), design, keep=keep, prepare=prepare,
                       score=None if market is None else (lambda r: r["market"] == market))


@query("i09_training_set_choice")
def training_set_choice(t):
    rows = full_cells(frame(t), ["fold", "market", "brand"])
    pools = {"pooled_tr_us": ("TR", "US"), "tr_only": ("TR",), "pooled_tr_us_eu": ("TR", "US", "EU"), "pooled_tr_eu": ("TR", "EU")}
    out = []
    for name, markets in pools.items():
        part = [dict(r) for r in rows if r["market"] in markets]
        design, _ = full_design(part)
        bare = [c for c in design.columns if not c.startswith("np_")]
        without, with_np = r2_of(part, bare, "TR", design), r2_of(part, None, "TR", design)
        out.append((name, without["n"], without["r2"], with_np["r2"]))
    best = max(out, key=lambda r: r[2])
    base = next(r for r in out if r[0] == "tr_only")
    chosen = best[0] if best[2] > base[2] + 0.02 else "tr_only"
    return t.spark.createDataFrame([(*r, r[0] == chosen, r[3] - r[2] >= 0.02) for r in out],
                                   "candidate string, n bigint, r2 double, r2_with_new_price double, chosen boolean, column_gains boolean")


@query("i10_brand_column_ablation", "listings", "WITH_RECURSIVE " + FULL_SQL + """,
kinds(tag, k) AS (VALUES ('all', 0), ('no_brand', 1), ('no_new_price', 2)),
kept AS (SELECT kinds.tag, fold, i, j, v FROM kinds, moments m WHERE k = 0 OR (k = 1 AND i NOT BETWEEN 8 AND 34 AND j NOT BETWEEN 8 AND 34) OR (k = 2 AND i NOT IN (4, 5) AND j NOT IN (4, 5))),""" + ridge_sql("fit", "kept", 34) + """
SELECT tag AS columns, (SELECT count(*) FROM columns) - CASE tag WHEN 'no_brand' THEN (SELECT count(*) FROM columns WHERE i >= 8) WHEN 'no_new_price' THEN 2 ELSE 0 END AS n_columns, round(r2, 6) AS r2 FROM fit_r2""")
def brand_ablation(t):
    rows = full_cells(frame(t), ["fold", "market", "brand"])
    design, _ = full_design(rows)
    sets = {"all": design.columns, "no_brand": [c for c in design.columns if not c.startswith("brand_used_")],
            "no_new_price": [c for c in design.columns if not c.startswith("np_")]}
    return t.spark.createDataFrame([(k, len(v), round(float(r2_of(rows, v, None, design)["r2"]), 6)) for k, v in sets.items()],
                                   "columns string, n_columns bigint, r2 double")


def calibration(t, df, rows, design, brands, splits=CALIBRATION_SPLITS, levels=(0.5, 0.8, 0.9)):
    """Coverage of bands built from inner out-of-fold residuals, over grouped splits.

    A split takes whole base cells of spec groups as its test side, so every
    outer and inner fit is a sum of the same cells.
    """
    prepare, fill = imputer(design, design.moments(rows))
    per_cell = {k: design.moments(v) for k, v in by_key(rows, "cell").items()}
    rng = np.random.default_rng(7)
    sides, outer, inner = [], [], []
    for s in range(splits):
        test = set(rng.permutation(SPLIT_CELLS)[: SPLIT_CELLS * TEST_SHARE // 100].tolist())
        sides.append(test)
        train = {k: m for k, m in per_cell.items() if k not in test}
        whole = sum(train.values())
        outer.append(({"split": s}, G.fit(prepare(whole), design.columns)))
        for f in range(5):
            held = sum((m for k, m in train.items() if k % 5 == f), np.zeros_like(whole))
            inner.append(({"split": s, "inner": f}, G.fit(prepare(whole - held), design.columns)))
    cats = {"market": ["TR", "EU", "US"], "brand_used": brands}
    filled = df.withColumn("np_value", F.when(F.col("np_missing") == 1, F.lit(float(fill))).otherwise(F.col("np_value")))
    filled = filled.withColumn("brand_used", F.when(F.col("brand").isin(brands), F.col("brand")).otherwise("other"))
    base = spread_out(cut_lineage(filled.select("cell", "market", "brand_used", *DENSE, "y").withColumn("inner", F.col("cell") % 5)))
    cells = list(range(SPLIT_CELLS))
    inside = X.replicas(inner, design, cats, ["split"], "cell", cells, lambda c, tag: c not in sides[tag[0]])
    outside = X.replicas(outer, design, cats, ["split"], "cell", cells, lambda c, tag: c in sides[tag[0]])
    probs = [p for lv in levels for p in ((1 - lv) / 2, 1 - (1 - lv) / 2)]
    names = [f"{e}{int(lv * 100)}" for lv in levels for e in ("lo", "hi")]
    offsets = cut_lineage(X.rounded_percentiles(base, inside, DENSE, probs, names))
    bands = {(r["split"],): [(r[f"lo{int(lv * 100)}"], r[f"hi{int(lv * 100)}"]) for lv in levels] for r in offsets.collect()}  # one row a split
    tested = X.covered(base, outside, DENSE, bands).join(offsets, "split")
    aggs = [F.sum("n").alias("n")]
    for i, lv in enumerate(levels):
        q = int(lv * 100)
        aggs += [(F.sum(f"hits_{i}") / F.sum("n")).alias(f"coverage_{q}"),
                 (F.sum(F.col("n") * F.expm1(F.col(f"hi{q}") - F.col(f"lo{q}"))) / F.sum("n")).alias(f"width_{q}")]
    return tested.agg(*aggs)


@query("i03_interval_calibration")
def interval_calibration(t):
    df = frame(t)
    rows = full_cells(df, ["cell", "market", "brand"])
    design, brands = full_design(rows)
    out = calibration(t, df, rows, design, brands)
    return out.select("n", *[F.round(c, 4).alias(c) for c in out.columns if c != "n"])


@query("i04_leave_one_brand_out")
def leave_one_brand_out(t):
    return brand_holdouts(t, 0.8)


def brand_holdouts(t, level, markets=("TR", "EU", "US")):
    """Every make of every market priced by a fit that never saw it."""
    df = cut_lineage(frame(t).select("listing_id", "market", "brand", "fold", *DENSE, "log_new_price", "y"))
    rows = full_cells(df, ["market", "brand", "fold"])
    outer, inner, fills = [], {}, []
    design0, brands = full_design(rows)
    for r in rows:
        r["moments"] = design0.moments([r])
    held_by_market = {m: sorted({r["brand"] for r in rows if r["market"] == m}) for m in markets}
    design = design0
    for m, held in held_by_market.items():
        mine = [r for r in rows if r["market"] == m]
        sizes = {b: sum(r["n"] for r in mine if r["brand"] == b) for b in held}
        for b in held:
            train = [r for r in mine if r["brand"] != b]
            if sizes[b] < 5 or len({r["brand"] for r in train}) < 2:
                continue
            whole = sum(r["moments"] for r in train)
            prepare, fill = imputer(design, whole)
            tag = {"market": m, "held": b}
            outer.append((tag, G.fit(prepare(whole), design.columns)))
            fills.append((m, b, float(fill)))
            for f, part in by_key(train, "fold").items():
                inner.setdefault(m, []).append(({"held": b, "fold": int(f)}, G.fit(prepare(whole - sum(r["moments"] for r in part)), design.columns)))
    cats = {"brand_used": brands}
    base = spread_out(df).withColumn("brand_used", F.col("brand")).select("market", "brand_used", "fold", *DENSE, "log_new_price", "y", F.col("listing_id").alias("_row"))
    plan = small_table(t.spark, fills, ["market", "held", "fill"])
    tail = (1 - level) / 2
    per_market = []
    for m, fits in inner.items():
        lines = X.replicas(fits, design, cats, ["held"], "brand_used", brands, lambda brand, tag: brand != tag[0], {(b,): v for k, b, v in fills if k == m})
        found = X.rounded_percentiles(base.where(F.col("market") == m), lines, DENSE, [tail, 1 - tail], ["lo", "hi"])
        per_market.append(found.withColumn("market", F.lit(m)))
    offsets = cut_lineage(reduce(DataFrame.unionByName, per_market))
    per_brand = df.groupBy("market", "brand").agg(F.min("log_new_price").alias("lo_np"), F.max("log_new_price").alias("hi_np"))
    support = plan.join(per_brand, "market").where("brand <> held").groupBy("market", "held").agg(
        F.min("lo_np").alias("np_lo"), F.max("hi_np").alias("np_hi"))
    unseen = base.withColumn("held", F.col("brand_used")).join(plan, ["market", "held"])
    test = unseen.withColumn("np_value", F.when(F.col("np_missing") == 1, F.col("fill")).otherwise(F.col("np_value"))).join(support, ["market", "held"])
    clipped = F.greatest(F.least(F.col("np_value"), F.coalesce("np_hi", "np_value")), F.coalesce("np_lo", "np_value"))
    test = test.withColumn("np_value", F.when(F.col("np_missing") == 1, F.col("np_value")).otherwise(clipped)).withColumn("brand_used", F.lit("other"))
    test = G.score(test, G.line_table(t.spark, outer, design, cats), ["market", "held", "brand_used"], design)
    test = test.withColumn("resid", F.col("y") - F.col("predicted")).join(offsets, ["market", "held"])
    need = F.when(F.col("resid") >= 0, F.col("resid") / F.col("hi")).otherwise(F.col("resid") / F.col("lo"))
    test = cut_lineage(test.withColumn("needed", need).withColumn("ape", F.abs(F.expm1("resid"))).select(
        "market", "held", "_row", "needed", "ape", "resid", "lo", "hi"))
    by = ["market", "held"]
    widen = G.widening_needed(test.select(*by, "needed", "_row"), by, level)
    middle = R.exact_percentiles(test, by, "ape", [0.5], ["median_ape"]).drop("n")
    stats = test.groupBy(*by).agg(F.count("*").alias("n_held_out"), F.round(F.avg(F.col("resid").between(F.col("lo"), F.col("hi")).cast("double")), 3).alias("coverage"))
    return stats.join(widen, by).join(middle, by).withColumn("median_ape", F.round("median_ape", 4))


# Columns of the statement: 1-3 dense, 4 other makes, 5-30 the makes. A tag is a held-out make.
HOLDOUT_SQL = FRAME_SQL + """,
d AS (SELECT listing_id, brand, fold, log1p_age - 2 AS x1, log_km - 12 AS x2, euro6 AS x3, y, y - 10 AS z, ln(new_price) AS p, new_price_source AS src, y - ln(new_price) AS k, count(*) OVER (PARTITION BY brand) AS size,
  CASE WHEN count(*) OVER (PARTITION BY brand) >= 3 THEN 4 + dense_rank() OVER (ORDER BY brand) ELSE 4 END AS b FROM frame WHERE market = 'TR'),
held AS (SELECT brand AS tag, max(size) AS size FROM d GROUP BY 1 HAVING max(size) >= 3 AND (SELECT count(*) FROM d) - max(size) >= 8),
long AS (SELECT listing_id, brand, fold, b, unnest([{'i': 0, 'x': 1.0::DOUBLE}, {'i': 1, 'x': x1}, {'i': 2, 'x': x2}, {'i': 3, 'x': x3}, {'i': 999, 'x': z}], recursive := true) FROM d),
pairs AS (SELECT s.brand, s.fold, s.b, s.i, t.i AS j, sum(s.x * t.x) AS v FROM long s JOIN long t USING (listing_id) GROUP BY ALL),
by_make AS (SELECT brand, fold, i, j, v FROM pairs UNION ALL SELECT brand, fold, b, j, v FROM pairs WHERE i = 0 UNION ALL SELECT brand, fold, j, b, v FROM pairs WHERE i = 0
  UNION ALL SELECT brand, fold, b, b, v FROM pairs WHERE i = 0 AND j = 0),
rest AS (SELECT tag, fold, i, j, sum(v) AS v FROM held JOIN by_make ON brand <> tag GROUP BY ALL),
rest_whole AS (SELECT tag, -1 AS fold, i, j, sum(v) AS v FROM rest GROUP BY ALL),
ret_long AS (SELECT listing_id, brand, fold, unnest([{'i': 0, 'x': 1.0::DOUBLE}, {'i': 1, 'x': x1}, {'i': 2, 'x': x2}, {'i': 999, 'x': k}], recursive := true) FROM d WHERE p IS NOT NULL),
ret_pairs AS (SELECT s.brand, s.fold, s.i, t.i AS j, sum(s.x * t.x) AS v FROM ret_long s JOIN ret_long t USING (listing_id) GROUP BY ALL),
ret AS (SELECT tag, fold, i, j, sum(v) AS v FROM held JOIN ret_pairs ON brand <> tag GROUP BY ALL),
ret_whole AS (SELECT tag, -1 AS fold, i, j, sum(v) AS v FROM ret GROUP BY ALL),""" + ",".join([
    ridge_sql("hed", "rest", 30), ridge_sql("full", "rest_whole", 30, False), ridge_sql("cur", "ret", 2), ridge_sql("curve", "ret_whole", 2, False)]) + """,
lines AS (SELECT 'hed' AS fit, * FROM hed_beta UNION ALL SELECT 'full', * FROM full_beta UNION ALL SELECT 'cur', * FROM cur_beta UNION ALL SELECT 'curve', * FROM curve_beta),
line AS (SELECT fit, tag, fold, max(CASE WHEN i = 0 THEN b END) AS b0, max(CASE WHEN i = 1 THEN b END) AS b1, max(CASE WHEN i = 2 THEN b END) AS b2, max(CASE WHEN i = 3 THEN b END) AS b3 FROM lines GROUP BY ALL),
inner_resid AS (SELECT l.tag, d.z + l.b0 + l.b1 * x1 + l.b2 * x2 + l.b3 * x3 + m.b AS r FROM d JOIN line l ON l.fit = 'hed' AND l.fold = d.fold AND l.tag <> d.brand
  JOIN lines m ON m.fit = 'hed' AND m.tag = l.tag AND m.fold = l.fold AND m.i = d.b),
spread AS (SELECT tag, stddev_pop(r) AS sd, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi FROM inner_resid GROUP BY 1),
ret_spread AS (SELECT l.tag, stddev_pop(d.k + l.b0 + l.b1 * x1 + l.b2 * x2) AS sd, count(*) AS n FROM d JOIN line l ON l.fit = 'cur' AND l.fold = d.fold AND l.tag <> d.brand WHERE d.p IS NOT NULL GROUP BY 1),
priced AS (SELECT d.brand, d.y, s.sd, s.lo, s.hi, 10 - (l.b0 + l.b1 * x1 + l.b2 * x2 + l.b3 * x3 + m.b) AS mu, CASE WHEN c.n >= 20 THEN d.p - (r.b0 + r.b1 * x1 + r.b2 * x2) END AS other, c.sd * CASE WHEN d.src = 'oem_official' THEN 1.0 ELSE 1.35 END AS osd
  FROM d JOIN spread s ON s.tag = d.brand JOIN line l ON l.fit = 'full' AND l.tag = d.brand JOIN lines m ON m.fit = 'full' AND m.tag = d.brand AND m.i = 4
  LEFT JOIN ret_spread c ON c.tag = d.brand LEFT JOIN line r ON r.fit = 'curve' AND r.tag = d.brand),
weighed AS (SELECT *, 1 / (sd * 1.85::DOUBLE) ** 2 AS w, CASE WHEN other IS NOT NULL THEN 1 / greatest(osd, 1e-6) ** 2 END AS v FROM priced),
blended AS (SELECT *, coalesce((w * mu + v * other) / (w + v), mu) AS both_mu, CASE WHEN other IS NULL THEN 1.85::DOUBLE ELSE greatest(1.0, sqrt(1 / (w + v)) / sd) END AS f, v / (w + v) AS weight FROM weighed),
report AS (SELECT brand, count(*) AS n_held_out, round(avg((y BETWEEN mu + lo * 1.85::DOUBLE AND mu + hi * 1.85::DOUBLE)::INT), 3) AS coverage_widened_only, round(avg((y BETWEEN both_mu + lo * f AND both_mu + hi * f)::INT), 3) AS coverage_with_anchor,
  round(median(abs(exp(mu - y) - 1)) * 100, 1) AS median_ape_widened_only, round(median(abs(exp(both_mu - y) - 1)) * 100, 1) AS median_ape_with_anchor,
  1.85::DOUBLE AS band_factor_widened_only, round(avg(f), 2) AS band_factor_with_anchor, round(coalesce(avg(weight), 0), 3) AS mean_anchor_weight FROM blended GROUP BY 1)"""


def anchor_report(t):
    report = H.holdout_report(H.price_unknown_makes(frame(t).where("market = 'TR'")))
    r = lambda c, n, name=None: F.round(c, n).alias(name or c)
    return report.select(F.col("held").alias("brand"), "n_held_out", r("coverage_widened_only", 3), r("coverage_with_anchor", 3), r("median_plain", 1, "median_ape_widened_only"),
                         r("median_anchored", 1, "median_ape_with_anchor"), F.lit(P.UNKNOWN_BRAND_WIDENING).alias("band_factor_widened_only"), r("band_factor_with_anchor", 2), r("mean_anchor_weight", 3))


@query("i07_anchor_holdout", "listings", "WITH_RECURSIVE " + HOLDOUT_SQL + " SELECT * FROM report")
def anchor_holdout(t):
    """Whole makes priced as unknowns: widening alone against the blended new-price route."""
    return anchor_report(t)


@query("i07_anchor_holdout_summary", "listings", "WITH_RECURSIVE " + HOLDOUT_SQL + """
SELECT count(*) > 0 AS ran, count(*) AS holdouts, round(median(median_ape_widened_only), 2) AS median_ape_widened_only, round(median(median_ape_with_anchor), 2) AS median_ape_with_anchor FROM report""")
def anchor_holdout_summary(t):
    """Medians of both routes' errors over the held-out makes."""
    report = anchor_report(t)
    return report.agg((F.count("*") > 0).alias("ran"), F.count("*").alias("holdouts"), F.round(F.median("median_ape_widened_only"), 2).alias("median_ape_widened_only"),
                      F.round(F.median("median_ape_with_anchor"), 2).alias("median_ape_with_anchor"))


PERMUTED_COLUMNS = ["log1p_age", "log_km", "euro6"]
NULL_DRAWS, EXACT_MODELS = 200, 8
# Columns of the statement: 1-3 dense, 4 the new price, 5 other makes, 6-30 the makes.
PERMUTATION_SQL = FRAME_SQL + """,
d AS (SELECT listing_id, fold, brand || '|' || model AS key, log1p_age - 2 AS x1, log_km - 12 AS x2, euro6 AS x3, ln(new_price) AS p, y - 10 AS z,
  CASE WHEN count(*) OVER (PARTITION BY brand) >= 5 THEN 5 + dense_rank() OVER (ORDER BY brand) ELSE 5 END AS b FROM frame WHERE market = 'TR' AND new_price IS NOT NULL),
long AS (SELECT fold, b, listing_id, unnest([{'i': 0, 'x': 1.0::DOUBLE}, {'i': 1, 'x': x1}, {'i': 2, 'x': x2}, {'i': 3, 'x': x3}, {'i': 999, 'x': z}], recursive := true) FROM d),
pairs AS (SELECT s.fold, s.b, s.i, t.i AS j, sum(s.x * t.x) AS v FROM long s JOIN long t USING (listing_id) GROUP BY ALL),
base AS (SELECT fold, i, j, sum(v) AS v FROM (SELECT fold, i, j, v FROM pairs UNION ALL SELECT fold, b, j, v FROM pairs WHERE i = 0 UNION ALL SELECT fold, j, b, v FROM pairs WHERE i = 0
  UNION ALL SELECT fold, b, b, v FROM pairs WHERE i = 0 AND j = 0) GROUP BY ALL),
keys AS (SELECT key, max(p) AS p FROM d GROUP BY 1),""" + permuted_sql("by_model", "keys", "p", "key", "", NULL_DRAWS, "np-model") + "," + permuted_sql("by_row", "d", "p", "listing_id", "", NULL_DRAWS, "np-row") + """,
cells AS (SELECT fold, b, key, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3, sum(z) AS sz FROM d GROUP BY ALL),
crossed AS (SELECT 'm' || draw AS tag, fold, b, sum(pv * n) AS c0, sum(pv * s1) AS c1, sum(pv * s2) AS c2, sum(pv * s3) AS c3, sum(pv * sz) AS cz, sum(pv * pv * n) AS cc
  FROM by_model JOIN cells USING (key) GROUP BY ALL
  UNION ALL SELECT 'r' || draw, fold, b, sum(pv), sum(pv * x1), sum(pv * x2), sum(pv * x3), sum(pv * z), sum(pv * pv) FROM by_row WHERE draw > 0 GROUP BY ALL),
priced AS (SELECT tag, fold, j, sum(v) AS v FROM (SELECT tag, fold, unnest([{'j': 0, 'v': c0}, {'j': 1, 'v': c1}, {'j': 2, 'v': c2}, {'j': 3, 'v': c3}, {'j': 999, 'v': cz}, {'j': 4, 'v': cc}, {'j': b, 'v': c0}], recursive := true)
  FROM crossed) GROUP BY ALL),
moments AS (SELECT tag, fold, i, j, v FROM (SELECT DISTINCT tag FROM crossed) CROSS JOIN base UNION ALL SELECT tag, fold, 4, j, v FROM priced UNION ALL SELECT tag, fold, j, 4, v FROM priced WHERE j <> 4),""" + ridge_sql(
    "fit", "moments", 30)


def grouped_r2(folds, columns):
    """Out-of-fold R2 at the fixed penalty, from moments by fold."""
    whole = sum(folds.values())
    left = sum(G.squared_error(m, columns, G.fit(whole - m, columns)) for m in folds.values())
    return float(1 - left / G.total_squares(whole))


def permuted_column(per_fold, design, sums, name="np", score=grouped_r2):
    """(draw -> score) of ``design`` with one more column, whose products with the others are given for each draw and fold.

    ``sums`` maps (draw, fold, x) to the sum of x times the column, x a column, 1, the target, or ``column^2``.
    """
    columns = [*design.columns, name]
    draws = sorted({d for d, _, _ in sums})
    at = len(columns)
    out = {}
    for d in draws:
        folds = {}
        for f, m in per_fold.items():
            big = np.insert(np.insert(m, at, 0.0, axis=0), at, 0.0, axis=1)
            line = np.array([sums.get((d, f, c), 0.0) for c in ["1", *design.columns, f"{name}^2", design.target]])
            big[at, :], big[:, at] = line, line
            folds[f] = big
        out[d] = score(folds, columns)
    return out


def price_nulls(df, draws=NULL_DRAWS, exact_models=EXACT_MODELS):
    """Is the new-price column worth its values? R2 of the truth, of permuted assignments to models, and of permuted rows.

    ``df`` has listing_id, brand, model, fold, y, the dense columns and log_new_price, one value for
    each (brand, model). The assignments of every model's price are permuted ``draws`` times, and all of
    them are tried where there are at most ``exact_models``; the rows' values are permuted ``draws`` times. The price is
    constant inside a (fold, brand, model) cell, so assignments are scored from the cells' sums.
    """
    xs = PERMUTED_COLUMNS
    counts = G.to_driver(df.groupBy("brand").agg(F.count("*").alias("n")))
    brands = sorted(r["brand"] for r in counts if r["n"] >= 5) + ["other"]
    moved = {c: F.col(c) - SHIFTS.get(c, 0.0) for c in [*xs, "y"]}
    df = cut_lineage(df.select("listing_id", "fold", "log_new_price", F.concat_ws("|", "brand", "model").alias("key"), *[v.alias(c) for c, v in moved.items()],
                               F.when(F.col("brand").isin(brands), F.col("brand")).otherwise("other").alias("brand_used")))
    design = G.Design(xs, {"brand_used": brands})
    cells = G.to_driver(G.moment_cells(df, ["fold", "brand_used"], xs, "y"))
    per_fold = {f: design.moments(rows) for f, rows in by_key(cells, "fold").items()}
    folds = sorted(per_fold)

    def in_design(draw, fold, brand, term, value, sums):
        names = {"1^2": ["np^2"], "1": ["1", f"brand_used_{brand}"]}.get(term, [term])
        for name in names:
            sums[draw, fold, name] = sums.get((draw, fold, name), 0.0) + value

    by_row: dict = {}
    for r in M.permuted_sums(df, "log_new_price", [*xs, "y"], "listing_id", draws, "np-row", by=["fold", "brand_used"]).collect():
        in_design(r.draw, r.fold, r.brand_used, r.term, r.value, by_row)
    n_of = {f: F.count(F.when(F.col("fold") == f, 1)).alias(f"{f}|1") for f in folds}
    sum_of = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0.0)).alias(f"{f}|{c}") for f in folds for c in [*xs, "y"]]
    keys = cut_lineage(df.groupBy("brand_used", "key").agg(F.max("log_new_price").alias("value"), *n_of.values(), *sum_of))
    names = [f"{f}|{c}" for f in folds for c in ["1", *xs, "y"]]
    by_model: dict = {}
    for r in M.permuted_sums(keys, "value", names, "key", draws, "np-model", by=["brand_used"], squares=[f"{f}|1" for f in folds]).collect():
        if "|" in r.term:
            fold, term = r.term.split("|")
            in_design(r.draw, int(fold), r.brand_used, {"1^2": "1^2"}.get(term, term), r.value, by_model)
    rows_null = permuted_column(per_fold, design, by_row)
    models_null = permuted_column(per_fold, design, by_model)
    observed = models_null.pop(0)
    rows_null.pop(0)
    few = keys.limit(exact_models + 1).collect()
    exact = None
    if 2 <= len(few) <= exact_models:
        exact = []
        for order in itertools.permutations([r["value"] for r in few]):
            sums: dict = {}
            for r, v in zip(few, order):
                for name in names:
                    fold, term = name.split("|")
                    in_design(0, int(fold), r["brand_used"], term, v * r[name], sums)
                    if term == "1":
                        in_design(0, int(fold), r["brand_used"], "1^2", v * v * r[name], sums)
            exact.append(permuted_column(per_fold, design, sums)[0])
    return {"observed": observed, "models": [models_null[d] for d in sorted(models_null)], "rows": [rows_null[d] for d in sorted(rows_null)], "exact": exact,
            "n_models": keys.count()}


@query("i08_new_price_permutations", "listings", "WITH_RECURSIVE " + PERMUTATION_SQL + """,
o AS (SELECT r2 AS observed FROM fit_r2 WHERE tag = 'm0'), m AS (SELECT * FROM fit_r2, o WHERE tag LIKE 'm%' AND tag <> 'm0'), w AS (SELECT * FROM fit_r2, o WHERE tag LIKE 'r%')
SELECT round(observed, 4) AS observed_r2, (SELECT count(*) FROM keys) AS n_models, NULL::BIGINT AS permutations, NULL::BIGINT AS rank_of_truth, NULL::DOUBLE AS p_exact, (SELECT count(*) FROM m) AS model_draws,
 (SELECT round((1 + count(*) FILTER (WHERE r2 >= observed - 1e-9)) / (1.0::DOUBLE + count(*)), 4) FROM m) AS p_models, (SELECT round(max(r2), 4) FROM m) AS models_max, (SELECT round(median(r2), 4) FROM m) AS models_median,
 (SELECT count(*) FROM w) AS row_draws, (SELECT round((1 + count(*) FILTER (WHERE r2 >= observed - 1e-9)) / (1.0::DOUBLE + count(*)), 4) FROM w) AS p_rows, (SELECT round(max(r2), 4) FROM w) AS rows_max, (SELECT round(avg(r2), 4) FROM w) AS rows_mean
FROM o""")
def new_price_permutations(t):
    """Truth against 200 assignments of the prices to models (all of them where models are few) and 200 permutations of the rows."""
    nulls = price_nulls(frame(t).where("market = 'TR' and new_price is not null"))
    observed, exact = nulls["observed"], nulls["exact"]
    reach = None if exact is None else sum(1 for v in exact if v >= observed - 1e-9)
    r4 = lambda v: round(float(v), 4)
    row = (r4(observed), nulls["n_models"], None if exact is None else len(exact), reach, None if exact is None else r4(reach / len(exact)),
           len(nulls["models"]), r4(M.exact_share(nulls["models"], observed)[1]), r4(max(nulls["models"])), r4(np.median(nulls["models"])),
           len(nulls["rows"]), r4(M.exact_share(nulls["rows"], observed)[1]), r4(max(nulls["rows"])), r4(np.mean(nulls["rows"])))
    return t.spark.createDataFrame([row], """observed_r2 double, n_models bigint, permutations bigint, rank_of_truth bigint, p_exact double, model_draws bigint,
        p_models double, models_max double, models_median double, row_draws bigint, p_rows double, rows_max double, rows_mean double""")


@query("i11_model_card")
def model_card(t):
    df = frame(t)
    rows = full_cells(df, ["cell", "fold", "market", "brand"])
    design, brands = full_design(rows)
    whole = design.moments(rows)
    prepare, fill = imputer(design, whole)
    model = G.fit(prepare(whole), design.columns)
    oof = r2_of(rows, None, None, design)
    support = df.agg(F.min("log_new_price").alias("np_low"), F.max("log_new_price").alias("np_high"), F.countDistinct("spec_group").alias("n_groups"))
    card = calibration(t, df, rows, design, brands, splits=8)
    out = R.with_row(support, card, "coverage_50", "coverage_80", "coverage_90", "width_80")
    return out.select(F.lit(oof["n"]).alias("n_listings"), "n_groups", F.array(*[F.lit(c) for c in model.columns]).alias("columns"),
                      F.array(*[F.lit(float(c)) for c in model.coef]).alias("coef"), F.lit(float(model.intercept + SHIFTS["y"])).alias("intercept"),
                      F.lit(float(oof["r2"])).alias("r2"), F.lit(float(np.sqrt(oof["sse"] / oof["n"]))).alias("residual_std"),
                      F.lit(float(fill)).alias("np_mean"), "np_low", "np_high", "coverage_50", "coverage_80", "coverage_90", "width_80")


# ---- applying a stored model ----

MODEL = P.PriceModel(
    brands=["BRAND#1", "BRAND#2", "BRAND#3", "BRAND#4", "BRAND#5", "BRAND#6", "BRAND#7", "BRAND#8", "other"],
    columns=["log1p_age", "log_km", "market_tr", "market_eu", "euro6", "brand_BRAND#1", "brand_BRAND#2"],
    coef=[-0.30, -0.12, 0.05, 0.02, 0.04, 0.06, -0.05], intercept=13.0, mean=[2.1, 12.9, 0.2, 0.2, 0.9, 0.04, 0.04],
    scale=[0.25, 0.8, 0.4, 0.4, 0.3, 0.2, 0.2], residual_std=0.1, offsets={"0.8": [-0.12, 0.14]}, widening={"unknown_brand": 1.85},
    anchor={"mean": [2.1, 12.9], "scale": [0.25, 0.8], "coef": [-0.2, -0.1], "intercept": 1.8, "residual_std": 0.09})
MU_SQL = """13.0 + (log1p_age - 2.1) / 0.25 * -0.30 + (log_km - 12.9) / 0.8 * -0.12 + (CAST(market = 'TR' AS INTEGER) - 0.2) / 0.4 * 0.05 + (CAST(market = 'EU' AS INTEGER) - 0.2) / 0.4 * 0.02
 + (euro6 - 0.9) / 0.3 * 0.04 + (CAST(brand = 'BRAND#1' AS INTEGER) - 0.04) / 0.2 * 0.06 + (CAST(brand = 'BRAND#2' AS INTEGER) - 0.04) / 0.2 * -0.05"""
ESTIMATE_SQL = NEW_PRICE_SQL + f""",
inp AS (SELECT listing_id, market, upper(make) AS brand, price, new_price, new_price_source, km IS NULL AS no_km, ln(1 + greatest(2026 - year, 0)) AS log1p_age,
  ln(greatest(coalesce(km, round(exp(12.9::DOUBLE))), 1000)) AS log_km, CAST(coalesce(nullif(euro_norm, ''), CASE WHEN year >= 2016 THEN 'Euro 6' ELSE 'Euro 5' END) = 'Euro 6' AS INTEGER) AS euro6 FROM npe),
e1 AS (SELECT *, ({MU_SQL})::DOUBLE AS mu0, CASE WHEN brand IN ('BRAND#1','BRAND#2','BRAND#3','BRAND#4','BRAND#5','BRAND#6','BRAND#7','BRAND#8','other') THEN 1.0::DOUBLE ELSE 1.85::DOUBLE END AS f0,
  round_even(new_price * round_even(exp(1.8 + (log1p_age - 2.1) / 0.25 * -0.2 + (log_km - 12.9) / 0.8 * -0.1), 4), -3) AS apt, 0.09::DOUBLE * CASE WHEN new_price_source = 'oem_official' THEN 1.0 ELSE 1.35 END AS asd FROM inp),
e2 AS (SELECT *, 1 / (0.1 * f0) ** 2 AS w, 1 / asd ** 2 AS v FROM e1),
e3 AS (SELECT *, CASE WHEN new_price IS NULL THEN mu0 ELSE (w * mu0 + v * ln(apt)) / (w + v) END AS mu,
  CASE WHEN new_price IS NULL THEN f0 ELSE greatest(1.0, sqrt(1 / (w + v)) / 0.1) END * CASE WHEN no_km THEN 1.6 ELSE 1.0 END AS f,
  CASE WHEN market = 'TR' THEN 250000.0::DOUBLE ELSE 7500.0::DOUBLE END AS fl FROM e2),
est AS (SELECT listing_id, price AS asking, f, CASE WHEN new_price IS NOT NULL THEN v / (w + v) END AS weight, exp(mu) < fl AS under,
  round_even(greatest(exp(mu), fl), -3) AS point, round_even(CASE WHEN exp(mu) < fl THEN greatest(exp(mu - 0.12 * f), fl * 0.85) ELSE exp(mu - 0.12 * f) END, -3) AS low,
  round_even(CASE WHEN exp(mu) < fl THEN greatest(exp(mu + 0.14 * f), fl * 1.15) ELSE exp(mu + 0.14 * f) END, -3) AS high FROM e3)"""


def priced_queries(t):
    return P.new_price_lookup(t.listings.withColumn("brand", L.normal_brand(F.col("make"))), new_prices(t), aliases(t)).drop("brand")


@query("i12_batch_estimate", "listings", ESTIMATE_SQL + " SELECT listing_id, point, low, high, round(f, 4) AS band_factor FROM est")
def batch_estimate(t):
    return P.batch_estimate(priced_queries(t), MODEL).select("listing_id", "point", "low", "high", F.round("band_factor", 4).alias("band_factor"))


@query("i06_anchor_blend", "listings", ESTIMATE_SQL + " SELECT listing_id, round(weight, 4) AS anchor_weight FROM est")
def anchor_blend(t):
    return P.batch_estimate(priced_queries(t), MODEL).select("listing_id", F.round("anchor_weight", 4).alias("anchor_weight"))


@query("b25_asking_price_verdict", "listings", ESTIMATE_SQL + """
SELECT listing_id, round_even(asking * 12, -3) AS asking_rounded, round((asking * 12 / ((low + high) / 2) - 1) * 100, 1) AS vs_comparables_pct, round((asking * 12 / point - 1) * 100, 1) AS vs_estimate_pct,
 asking * 12 BETWEEN low AND high AS inside_comparable_band, asking * 12 BETWEEN low AND high AS inside_estimate_band,
 CASE WHEN asking * 12 BETWEEN low AND high THEN 'in line with the market' WHEN asking * 12 > high THEN 'above the market' ELSE 'below the market' END AS label FROM est""")
def asking_price_verdict(t):
    est = P.batch_estimate(priced_queries(t), MODEL)
    return est.select("listing_id", *[c.alias(n) for n, c in P.asking_verdict(F.col("price") * 12).items()])


@query("b26_salvage_floor", "listings", ESTIMATE_SQL + " SELECT listing_id, point, low, high FROM est WHERE under")
def salvage_floor(t):
    est = P.batch_estimate(priced_queries(t), MODEL)
    return est.where("floored").select("listing_id", "point", "low", "high")


@query("b24_term_contributions", "listings", FRAME_SQL + """,
p AS (SELECT listing_id, unnest(['log1p_age','log_km','market_tr','market_eu','euro6','brand_BRAND#1','brand_BRAND#2']) AS feature,
 unnest([(log1p_age - 2.1) / 0.25 * -0.30, (log_km - 12.9) / 0.8 * -0.12, (CAST(market = 'TR' AS INTEGER) - 0.2) / 0.4 * 0.05, (CAST(market = 'EU' AS INTEGER) - 0.2) / 0.4 * 0.02, (euro6 - 0.9) / 0.3 * 0.04,
  (CAST(brand = 'BRAND#1' AS INTEGER) - 0.04) / 0.2 * 0.06, (CAST(brand = 'BRAND#2' AS INTEGER) - 0.04) / 0.2 * -0.05]) AS part,
 unnest([1, 1, 1, 1, 1, CAST(brand = 'BRAND#1' AS INTEGER), CAST(brand = 'BRAND#2' AS INTEGER)]) AS live FROM frame)
SELECT listing_id, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY round(-abs(part), 4), feature) AS INTEGER) AS place, feature, round(part, 4) AS effect, round((exp(part) - 1) * 100, 1) AS pct
FROM p WHERE abs(part) >= 1e-6 AND live = 1""")
def term_contributions(t):
    df = P.with_inputs(t.listings.where("price > 0 and km is not null"), MODEL)
    return df.select("listing_id", F.posexplode(P.contributions(MODEL)).alias("place", "c")).select(
        "listing_id", (F.col("place") + 1).alias("place"), "c.feature", "c.effect", "c.pct")


@query("f23_missing_inputs", "listings", """
SELECT listing_id, CASE WHEN km IS NULL THEN 'fleet_typical' ELSE 'stated' END AS km_source, coalesce(km, 400312) AS km,
 round(CASE WHEN km IS NULL THEN 1.6 ELSE 1 END * 1.12::DOUBLE ** (n_images % 4), 4) AS widening FROM listings""")
def missing_inputs(t):
    df = P.with_inputs(t.listings, MODEL)
    missing = (F.col("km_source") == "fleet_typical").cast("int")
    widening = F.pow(F.lit(P.MISSING_INPUT_WIDENING), missing) * F.pow(F.lit(P.MISSING_VIEW_WIDENING), F.col("n_images") % 4)
    return df.select("listing_id", "km_source", "km", F.round(widening, 4).alias("widening"))


@query("d07_comparables", "listings", FRAME_SQL + """,
s AS (SELECT stddev_samp(log1p_age) AS sa, stddev_samp(log_km) AS sk FROM frame),
z AS (SELECT listing_id, market, brand, log1p_age / sa AS x, log_km / sk AS y FROM frame, s),
p AS (SELECT a.listing_id, b.listing_id AS comparable, floor(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) / 1e-9 + 0.5) AS d FROM z a JOIN z b ON a.market = b.market AND a.brand = b.brand AND a.listing_id <> b.listing_id)
SELECT listing_id, comparable, CAST(rank AS INTEGER) AS rank, round(d * 1e-9, 3) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY d, comparable) AS rank FROM p) WHERE rank <= 5""")
def comparables(t):
    df = frame(t)
    spread = df.agg(F.stddev("log1p_age").alias("sa"), F.stddev("log_km").alias("sk"))
    z = R.with_row(df, spread, "sa", "sk").select(
        F.col("listing_id").alias("id"), "market", "brand", (F.col("log1p_age") / F.col("sa")).alias("x"), (F.col("log_km") / F.col("sk")).alias("y"))
    # Makes too rare for k neighbours of their own look in the whole market.
    sizes = z.groupBy("market", "brand").agg(F.count("*").alias("_n"))
    z = cut_lineage(z.join(sizes, ["market", "brand"]))
    rare = z.where("_n < 6")
    near = N.nearest_in_plane(z.where("_n >= 6").drop("_n"), z.drop("_n"), ["market", "brand"], 5)
    if not rare.isEmpty():
        near = near.unionByName(N.nearest_in_plane(rare.drop("_n", "brand"), z.drop("_n", "brand"), ["market"], 5))
    return near.select(F.col("q_id").alias("listing_id"), F.col("n_id").alias("comparable"), "rank", F.round("distance", 3).alias("distance"))
