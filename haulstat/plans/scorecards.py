"""Scorecards: intervals, rates, gates, differences, sweeps, facets, rank correlations."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import facets as FA
from ..operators import intervals as I
from ..operators import permutations as M
from ..operators import ranking as R
from ..operators import regression as G
from ..session import cut_lineage
from .registry import query
from .statements import permuted_sql

WILSON_SQL = """CASE WHEN n > 0 THEN greatest(0, (h / n + 3.8416 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) END AS ci_lo,
 CASE WHEN n > 0 THEN least(1, (h / n + 3.8416 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) END AS ci_hi"""
CARD_SQL = f"""
s AS (SELECT run, suite, sum(n)::DOUBLE AS n, sum(hits)::DOUBLE AS h FROM metric_units GROUP BY 1, 2),
card AS (SELECT run, suite, 'hit_rate' AS metric, h / n AS value, {WILSON_SQL} FROM s
 UNION ALL SELECT run, suite, 'per_unit', n / 100, NULL, NULL FROM s WHERE NOT (run = 'after' AND suite = 'click'))"""


def card(t):
    s = t.metric_units.groupBy("run", "suite").agg(F.sum("n").alias("n"), F.sum("hits").alias("h"))
    lo, hi = I.wilson(F.col("h"), F.col("n"))
    rate = s.select("run", "suite", F.lit("hit_rate").alias("metric"), (F.col("h") / F.col("n")).alias("value"), lo.alias("ci_lo"), hi.alias("ci_hi"))
    none = F.lit(None).cast("double")
    size = s.where("not (run = 'after' and suite = 'click')").select(
        "run", "suite", F.lit("per_unit").alias("metric"), (F.col("n") / 100).alias("value"), none.alias("ci_lo"), none.alias("ci_hi"))
    return rate.unionByName(size)


@query("g01_wilson_interval", "metric_units", CARD_SQL + " SELECT run, suite, round(value, 4) AS value, round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi FROM card WHERE metric = 'hit_rate'")
def wilson_interval(t):
    r = lambda c: F.round(c, 4).alias(c)
    return card(t).where("metric = 'hit_rate'").select("run", "suite", r("value"), r("ci_lo"), r("ci_hi"))


POISSON_SQL = " + ".join(f"CAST(u > {c!r}::DOUBLE AS INTEGER)" for c in I.POISSON_ONE)


@query("g02_unit_bootstrap", "metric_units", f"""
d AS (SELECT run, suite, draw, unit, n, hits, (('0x' || substr(md5('7|' || CAST(draw AS VARCHAR) || '|' || unit), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE AS u FROM metric_units, (SELECT unnest(range(2000)) AS draw)),
w AS (SELECT run, suite, draw, sum(hits * ({POISSON_SQL})) AS h, sum(n * ({POISSON_SQL})) AS n FROM d GROUP BY 1, 2, 3),
v AS (SELECT run, suite, list_sort(list(h / n)) AS s FROM w WHERE n > 0 GROUP BY 1, 2)
SELECT run, suite, (SELECT count(*) FROM metric_units m WHERE m.run = v.run AND m.suite = v.suite) AS units, round(s[CAST(greatest(0, floor(len(s) * 0.05 / 2)) AS BIGINT) + 1], 4) AS ci_lo,
 round(s[CAST(ceil(len(s) * (1 - 0.05 / 2)) AS BIGINT)], 4) AS ci_hi FROM v""")
def unit_bootstrap(t):
    out = I.bootstrap(t.metric_units, ["run", "suite"], "unit", ["n", "hits"], lambda s: F.when(s["n"] > 0, s["hits"] / s["n"]), draws=2000)
    return out.select("run", "suite", "units", F.round("ci_lo", 4).alias("ci_lo"), F.round("ci_hi", 4).alias("ci_hi"))


@query("g03_macro_rate", "metric_units", """
b AS (SELECT suite, unit, sum(hits) / nullif(sum(n), 0) AS rate, max(CASE WHEN run = 'after' THEN hits / n END) - max(CASE WHEN run = 'before' THEN hits / n END) AS delta FROM metric_units GROUP BY 1, 2)
SELECT suite, round(avg(rate), 4) AS macro_rate, round(avg(delta), 4) AS mean_paired_delta, count(delta) AS paired_units FROM b GROUP BY 1""")
def macro_rate(t):
    share = F.col("hits") / F.col("n")
    b = t.metric_units.groupBy("suite", "unit").agg(
        (F.sum("hits") / F.sum("n")).alias("rate"),
        (F.max(F.when(F.col("run") == "after", share)) - F.max(F.when(F.col("run") == "before", share))).alias("delta"))
    return b.groupBy("suite").agg(F.round(F.avg("rate"), 4).alias("macro_rate"), F.round(F.avg("delta"), 4).alias("mean_paired_delta"), F.count("delta").alias("paired_units"))


@query("d18_scorecard_diff", "metric_units", CARD_SQL + """,
j AS (SELECT coalesce(b.suite, a.suite) AS suite, coalesce(b.metric, a.metric) AS metric, b.value AS before, a.value AS after, b.ci_lo AS bl, b.ci_hi AS bh, a.ci_lo AS al, a.ci_hi AS ah
 FROM (SELECT * FROM card WHERE run = 'before') b FULL JOIN (SELECT * FROM card WHERE run = 'after') a ON a.suite = b.suite AND a.metric = b.metric),
k AS (SELECT *, CASE WHEN before IS NULL OR after IS NULL THEN 'metric only in one run' WHEN bl IS NOT NULL AND after BETWEEN bl AND bh THEN 'inside the before interval' WHEN bl IS NOT NULL AND al IS NOT NULL AND bl <= ah AND al <= bh THEN 'intervals overlap'
 WHEN bl IS NULL AND al IS NULL THEN 'no interval' ELSE '' END AS reason FROM j)
SELECT suite, metric, round(before, 4) AS before, round(after, 4) AS after, round(after - before, 4) AS delta, reason, reason <> '' AS within_noise FROM k""")
def scorecard_diff(t):
    c = card(t)
    out = I.scorecard_diff(c.where("run = 'before'"), c.where("run = 'after'"))
    return out.select("suite", "metric", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), "delta", "reason", "within_noise")


@query("g17_gates", "metric_units", CARD_SQL + """
SELECT run, suite, metric, CASE WHEN suite = 'error' THEN NULL ELSE value >= 0.3 END AS passed_above, CASE WHEN suite = 'error' THEN NULL ELSE value <= 0.3 END AS passed_below FROM card""")
def gates(t):
    value = F.when(F.col("suite") != "error", F.col("value"))
    return card(t).select("run", "suite", "metric", I.gate_passed(value, F.lit(0.3), F.lit("above")).alias("passed_above"),
                          I.gate_passed(value, F.lit(0.3), F.lit("below")).alias("passed_below"))


@query("g18_noise_rule", "metric_units", CARD_SQL + """
SELECT a.suite, a.metric, a.run AS run, CASE WHEN b.ci_lo IS NOT NULL AND a.value BETWEEN b.ci_lo AND b.ci_hi THEN 'inside the before interval' WHEN b.ci_lo IS NOT NULL AND b.ci_lo <= a.ci_hi AND a.ci_lo <= b.ci_hi THEN 'intervals overlap'
 WHEN b.ci_lo IS NULL THEN 'no interval' ELSE '' END AS reason FROM card a JOIN card b ON a.suite = 'error' AND b.suite = 'view' AND a.metric = b.metric AND a.run = b.run""")
def noise_rule(t):
    c = card(t)
    a, b = c.where("suite = 'error'").alias("a"), c.where("suite = 'view'").alias("b")
    j = a.join(b, (F.col("a.metric") == F.col("b.metric")) & (F.col("a.run") == F.col("b.run")))
    reason = I.noise_reason(*[F.col(x) for x in ("b.value", "a.value", "b.ci_lo", "b.ci_hi", "a.ci_lo", "a.ci_hi")])
    return j.select("a.suite", "a.metric", "a.run", reason.alias("reason"))


@query("g19_threshold_sweep", oracle="""
s AS (SELECT event_type, v AS threshold, avg(CAST(value >= v AS INTEGER)) AS share_above, count_if(event_type = 'none') AS never FROM events, (SELECT unnest([1.0, 10.0, 50.0, 200.0])::DOUBLE AS v) GROUP BY 1, 2)
SELECT event_type, threshold, round(share_above, 6) AS share_above, never, min(share_above) OVER (PARTITION BY event_type) <> max(share_above) OVER (PARTITION BY event_type) AS share_above_moves,
 min(never) OVER (PARTITION BY event_type) <> max(never) OVER (PARTITION BY event_type) AS never_moves FROM s""")
def threshold_sweep(t):
    out = I.sweep(t.events.select("event_type", "value"), [1.0, 10.0, 50.0, 200.0], ["event_type"],
                  lambda th: {"share_above": F.avg((F.col("value") >= th).cast("int")), "never": F.count_if(F.col("event_type") == "none")})
    return out.withColumn("share_above", F.round("share_above", 6))


@query("e13_cut_sweep", oracle="""
c AS (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0])::DOUBLE AS cut),
s AS (SELECT cut, count_if(event_type = 'error' AND value < cut) / count_if(event_type = 'error') AS caught, count_if(event_type <> 'error' AND value < cut) / count_if(event_type <> 'error') AS lost FROM events, c GROUP BY 1)
SELECT cut, round(caught, 6) AS caught, round(lost, 6) AS lost, cut = (SELECT max(cut) FROM s WHERE lost <= 0.3) AS chosen FROM s""")
def cut_sweep(t):
    df = t.events.select("value", (F.col("event_type") == "error").alias("flag"))
    s = cut_lineage(I.histogram_sweep(df, [], "value", "flag", [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]))
    best = s.where("other_rate <= 0.3").agg(F.max("cut").alias("best"))
    return R.with_row(s, best, "best").select("cut", F.round("flagged_rate", 6).alias("caught"), F.round("other_rate", 6).alias("lost"), (F.col("cut") == F.col("best")).alias("chosen"))


GRADES = ["poor", "fair", "good", "excellent"]


@query("g15_grade_distribution", "ratings", f"""
n AS (SELECT unit, vehicle, CAST(floor(avg(level)) AS INTEGER) AS grade, max(level) AS model_grade FROM ratings GROUP BY 1, 2),
x AS (SELECT 'all' AS facet, 'all' AS label, grade FROM n UNION ALL SELECT 'vehicle_digit', right(vehicle, 1), grade FROM n),
t AS (SELECT facet, label, count(*) AS n FROM x GROUP BY 1, 2),
g AS (SELECT x.facet, x.label, x.grade, count(*)::DOUBLE AS h, any_value(t.n)::DOUBLE AS n FROM x JOIN t ON t.facet = x.facet AND t.label = x.label GROUP BY 1, 2, 3)
SELECT facet, label, grade, round(h / n, 4) AS share, round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi FROM (SELECT *, {WILSON_SQL} FROM g)""")
def grade_distribution(t):
    n = t.ratings.groupBy("unit", "vehicle").agg(F.floor(F.avg("level")).cast("int").alias("grade"))
    n = n.withColumn("vehicle_digit", F.right("vehicle", F.lit(1))).groupBy("vehicle_digit", "grade").agg(F.count("*").alias("k"))
    cells = n.groupingSets([["grade"], ["vehicle_digit", "grade"]], "vehicle_digit", "grade").agg(F.sum("k").alias("h"), F.grouping("vehicle_digit").alias("g"))
    cells = cells.select(F.when(F.col("g") == 1, "all").otherwise("vehicle_digit").alias("facet"), F.when(F.col("g") == 1, "all").otherwise(F.col("vehicle_digit")).alias("label"), "grade", "h")
    totals = cells.groupBy("facet", "label").agg(F.sum("h").alias("n"))
    lo, hi = I.wilson(F.col("h"), F.col("n"))
    return cells.join(totals, ["facet", "label"]).select("facet", "label", "grade", F.round(F.col("h") / F.col("n"), 4).alias("share"), F.round(lo, 4).alias("ci_lo"), F.round(hi, 4).alias("ci_hi"))


@query("g15_model_against_rollup", "ratings", """
n AS (SELECT unit, CAST(floor(avg(level)) AS INTEGER) AS grade, max(level) AS model_grade FROM ratings GROUP BY 1)
SELECT count(*) AS n, round(avg(CAST(grade = model_grade AS INTEGER)), 6) AS agreement, round(avg(model_grade - grade), 6) AS signed_bias FROM n""")
def model_against_rollup(t):
    n = t.ratings.groupBy("unit").agg(F.floor(F.avg("level")).cast("int").alias("grade"), F.max("level").alias("model"))
    return n.agg(F.count("*").alias("n"), F.round(F.avg((F.col("grade") == F.col("model")).cast("int")), 6).alias("agreement"),
                 F.round(F.avg(F.col("model") - F.col("grade")), 6).alias("signed_bias"))


@query("g16_expectations", "ratings", """
a AS (SELECT vehicle AS case_id, CAST(floor(avg(level)) AS INTEGER) AS grade, avg(level) AS score FROM ratings GROUP BY 1),
e AS (SELECT case_id, CASE CAST(case_id AS INTEGER) % 3 WHEN 0 THEN [0, 1] WHEN 1 THEN [1, 2] ELSE [2, 3] END AS allowed, CAST(CAST(case_id AS INTEGER) + 1 AS VARCHAR) AS other FROM a)
SELECT a.case_id, a.grade, list_contains(e.allowed, a.grade) AS allowed, a.score >= b.score AS not_worse_than_next FROM a JOIN e USING (case_id) LEFT JOIN a b ON b.case_id = e.other""")
def expectations(t):
    a = t.ratings.groupBy(F.col("vehicle").alias("case_id")).agg(F.floor(F.avg("level")).cast("int").alias("grade"), F.avg("level").alias("score"))
    sets = F.when(F.col("case_id").cast("int") % 3 == 0, F.array(F.lit(0), F.lit(1))).when(F.col("case_id").cast("int") % 3 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3)))
    expected = a.select("case_id", sets.alias("expected"), (F.col("case_id").cast("int") + 1).cast("string").alias("other"))
    nxt = a.select(F.col("case_id").alias("other"), F.col("score").alias("other_score"))
    return a.join(expected, "case_id").join(nxt, "other", "left").select(
        "case_id", "grade", F.array_contains("expected", F.col("grade")).alias("allowed"), (F.col("score") >= F.col("other_score")).alias("not_worse_than_next"))


@query("g21_faceted_counts", "listings", """
c AS (SELECT *, market IN ('TR', 'US') AS gm, year >= 2018 AS gy, km < 300000 OR km BETWEEN 300000 AND 499999 AS gk FROM listings)
SELECT 'market' AS facet, o AS option, count_if(market = o AND coalesce(gy, false) AND coalesce(gk, false)) AS n FROM c, (SELECT unnest(['TR', 'US', 'EU', 'XX']) AS o) GROUP BY 2
UNION ALL SELECT 'year', o, count_if(CASE o WHEN 'y18' THEN year >= 2018 WHEN 'y15' THEN year BETWEEN 2015 AND 2017 ELSE year < 2015 END AND gm AND coalesce(gk, false)) FROM c, (SELECT unnest(['y18', 'y15', 'y00']) AS o) GROUP BY 2
UNION ALL SELECT 'km', o, count_if(CASE o WHEN 'low' THEN km < 300000 WHEN 'mid' THEN km >= 300000 AND km < 500000 ELSE km >= 500000 END AND gm AND gy) FROM c, (SELECT unnest(['low', 'mid', 'high']) AS o) GROUP BY 2""")
def faceted_counts(t):
    c = F.col
    groups = {"market": {m: c("market") == m for m in ("TR", "US", "EU", "XX")},
              "year": {"y18": c("year") >= 2018, "y15": c("year").between(2015, 2017), "y00": c("year") < 2015},
              "km": {"low": c("km") < 300000, "mid": (c("km") >= 300000) & (c("km") < 500000), "high": c("km") >= 500000}}
    return FA.facet_counts(t.listings, groups, {"market": ["TR", "US"], "year": ["y18"], "km": ["low", "mid"]})


@query("g22_facet_vocabulary", "listings", """
SELECT 'make' AS facet, make AS value, count(*) AS n, min(year) AS year_min, max(year) AS year_max FROM listings GROUP BY 2 UNION ALL SELECT 'market', market, count(*), min(year), max(year) FROM listings GROUP BY 2""")
def facet_vocabulary(t):
    cells = t.listings.groupBy("make", "market").agg(F.count("*").alias("k"), F.min("year").alias("lo"), F.max("year").alias("hi"))
    sets = cells.groupingSets([["make"], ["market"]], "make", "market").agg(
        F.sum("k").alias("n"), F.min("lo").alias("year_min"), F.max("hi").alias("year_max"), F.grouping("market").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "make").otherwise("market").alias("facet"), F.when(F.col("g") == 1, F.col("make")).otherwise(F.col("market")).alias("value"), "n", "year_min", "year_max")


# ---- rank correlations ----

def correlations(row, names):
    """Matrix of correlations from sums (n, s_a, s_a_b) of the named columns."""
    m = np.empty((len(names), len(names)))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            ab = row.get(f"s_{a}_{b}", row.get(f"s_{b}_{a}"))
            cov = ab - row[f"s_{a}"] * row[f"s_{b}"] / row["n"]
            m[i, j] = cov
    d = np.sqrt(np.diag(m))
    return m / np.outer(d, d)


def partial(r, a, b, controls):
    """Correlation of a and b with the controls taken out."""
    pair = [a, b]
    left = r[np.ix_(pair, pair)] - r[np.ix_(pair, controls)] @ np.linalg.pinv(r[np.ix_(controls, controls)]) @ r[np.ix_(controls, pair)]
    spread = left[0, 0] * left[1, 1]
    return float(left[0, 1] / np.sqrt(spread)) if spread > 0 else float("nan")


def rank_frame(t):
    df = cut_lineage(t.listings.where("km is not null").select("listing_id", "market", "make", "km", (-F.col("year")).alias("age"), F.col("price").alias("demerit"), F.col("n_images").alias("quality")))
    for c in ("demerit", "km", "age", "quality"):
        df = R.rank_with_ties(df, [], c, f"r_{c}").drop(f"r_{c}_low")
    return df.select("listing_id", "market", "make", *[F.col(f"r_{c}").alias(f"{c}_r") for c in ("demerit", "km", "age", "quality")])


@query("i16_rank_correlations", "listings", """
r AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS d, rank() OVER (ORDER BY km) + (count(*) OVER (PARTITION BY km) - 1) / 2.0::DOUBLE AS k,
 rank() OVER (ORDER BY -year) + (count(*) OVER (PARTITION BY year) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY n_images) + (count(*) OVER (PARTITION BY n_images) - 1) / 2.0::DOUBLE AS q FROM listings WHERE km IS NOT NULL),
c AS (SELECT count(*) AS n, corr(d, k) AS dk, corr(d, a) AS da, corr(k, a) AS ka, corr(d, q) AS dq, corr(k, q) AS kq, corr(a, q) AS aq FROM r),
p AS (SELECT *, (dk - da * ka) / sqrt((1 - da * da) * (1 - ka * ka)) AS dk_a, (dq - da * aq) / sqrt((1 - da * da) * (1 - aq * aq)) AS dq_a, (kq - ka * aq) / sqrt((1 - ka * ka) * (1 - aq * aq)) AS kq_a FROM c)
SELECT n, round(dk, 6) AS rho_km, round(da, 6) AS rho_age, round((dk_a - dq_a * kq_a) / sqrt((1 - dq_a * dq_a) * (1 - kq_a * kq_a)), 6) AS rho_partial FROM p""")
def rank_correlations(t):
    names = ["demerit_r", "km_r", "age_r", "quality_r"]
    row = rank_sums(rank_frame(t), [], names)[0]
    r = correlations(row, names)
    return t.spark.createDataFrame([(row["n"], round(float(r[0, 1]), 6), round(float(r[0, 2]), 6), round(partial(r, 0, 1, [2, 3]), 6))],
                                   "n bigint, rho_km double, rho_age double, rho_partial double")


def rank_sums(df, by, names):
    sums = [F.count("*").alias("n"), *[F.sum(a).alias(f"s_{a}") for a in names],
            *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]]
    return G.to_driver(df.groupBy(*by).agg(*sums))


STRATIFIED_DRAWS = 2000
STRATIFIED_SQL = """
r0 AS (SELECT listing_id, market, make, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS d, rank() OVER (ORDER BY km) + (count(*) OVER (PARTITION BY km) - 1) / 2.0::DOUBLE AS k,
 rank() OVER (ORDER BY -year) + (count(*) OVER (PARTITION BY year) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY n_images) + (count(*) OVER (PARTITION BY n_images) - 1) / 2.0::DOUBLE AS q, count(*) OVER () AS n FROM listings WHERE km IS NOT NULL),
r AS (SELECT listing_id, market, make, n, d - (n + 1) / 2.0::DOUBLE AS d, k - (n + 1) / 2.0::DOUBLE AS k, a - (n + 1) / 2.0::DOUBLE AS a, q - (n + 1) / 2.0::DOUBLE AS q FROM r0),
fixed AS (SELECT sum(d * d) AS dd, sum(a * a) AS aa, sum(q * q) AS qq, sum(k * k) AS kk, sum(d * a) AS da, sum(d * q) AS dq, sum(a * q) AS aq FROM r),""" + permuted_sql(
    "shuffled", "r", "k", "listing_id", "market, make", STRATIFIED_DRAWS, "null") + """,
c AS (SELECT draw, sum(d * pv) / sqrt(any_value(dd) * any_value(kk)) AS dk, sum(pv * a) / sqrt(any_value(kk) * any_value(aa)) AS ka, sum(pv * q) / sqrt(any_value(kk) * any_value(qq)) AS kq,
  any_value(da / sqrt(dd * aa)) AS da, any_value(dq / sqrt(dd * qq)) AS dq, any_value(aq / sqrt(aa * qq)) AS aq FROM shuffled, fixed GROUP BY 1),
p AS (SELECT draw, (dk - da * ka) / sqrt((1 - da * da) * (1 - ka * ka)) AS dk_a, (dq - da * aq) / sqrt((1 - da * da) * (1 - aq * aq)) AS dq_a, (kq - ka * aq) / sqrt((1 - ka * ka) * (1 - aq * aq)) AS kq_a FROM c),
s AS (SELECT draw, (dk_a - dq_a * kq_a) / sqrt((1 - dq_a * dq_a) * (1 - kq_a * kq_a)) AS rho FROM p), o AS (SELECT rho AS observed FROM s WHERE draw = 0)"""


@query("i16_stratified_null", "listings", STRATIFIED_SQL + """
SELECT round(max(observed), 6) AS rho_partial, count(*) AS draws, round(avg(rho), 6) AS null_mean, round(quantile_cont(rho, 0.025), 6) AS null_low, round(quantile_cont(rho, 0.975), 6) AS null_high,
 round((1 + count(*) FILTER (WHERE rho <= observed + 1e-12)) / (1.0::DOUBLE + count(*)), 6) AS negative_tail_p FROM s, o WHERE draw > 0""")
def stratified_null(t, draws: int = STRATIFIED_DRAWS):
    """Distances permuted inside (market, make): how often is the partial correlation at least this negative?

    Only the products of the permuted rank with the three other ranks change from draw to draw,
    so a draw is four sums, added up where the rows are.
    """
    ranks = cut_lineage(rank_frame(t))
    n = ranks.agg(F.count("*").alias("n"))
    names = ["demerit_r", "km_r", "age_r", "quality_r"]
    centred = R.with_row(ranks, n, "n")
    centred = centred.select("listing_id", "market", "make", *[(F.col(c) - (F.col("n") + 1) / 2.0).alias(c) for c in names])
    fixed = correlation_sums(centred, names)
    others = ["demerit_r", "age_r", "quality_r"]
    sums = M.permuted_sums(centred, "km_r", others, "listing_id", draws, "null", strata=["market", "make"])
    wide = sums.where(F.col("term").isin(others)).groupBy("draw").pivot("term", others).agg(F.first("value")).collect()
    scores = {}
    for r in wide:
        products = fixed.copy()
        for c in others:
            i, j = names.index(c), names.index("km_r")
            products[i, j] = products[j, i] = r[c]
        scale = np.sqrt(np.diag(products))
        scores[r["draw"]] = partial(products / np.outer(scale, scale), 0, 1, [2, 3])
    observed = scores.pop(0)
    null = np.array([v for v in scores.values() if np.isfinite(v)])
    p = (1 + int((null <= observed + 1e-12).sum())) / (len(null) + 1)
    r6 = lambda v: round(float(v), 6)
    low, high = np.quantile(null, [0.025, 0.975])
    return t.spark.createDataFrame([(r6(observed), len(null), r6(null.mean()), r6(low), r6(high), r6(p))],
                                   "rho_partial double, draws bigint, null_mean double, null_low double, null_high double, negative_tail_p double")


def correlation_sums(centred, names):
    """Products of centred columns, summed."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = centred.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(names), len(names)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"p{i}_{j}"]
    return out
