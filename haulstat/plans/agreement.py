"""Rater-agreement queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import ranking as R
from .registry import query

UNIT = ["unit"]
K = 4
N_SQL = """
n AS (SELECT unit, any_value(vehicle) AS vehicle, count(*) AS m, count_if(level = 0) AS n0, count_if(level = 1) AS n1, count_if(level = 2) AS n2, count_if(level = 3) AS n3 FROM ratings GROUP BY unit)"""
VIS_SQL = N_SQL.replace("FROM ratings", "FROM ratings WHERE hidden = 0")


def pair_alpha_sql(source: str, value: str, metric: str, name: str) -> str:
    """Alpha the long way: every ordered pair of readings of a unit."""
    delta = {"nominal": "1.0", "interval": "(p.a - p.b) ** 2",
             "ordinal": "((SELECT sum(c) FROM mg WHERE v BETWEEN least(p.a, p.b) AND greatest(p.a, p.b)) - ((SELECT c FROM mg WHERE v = p.a) + (SELECT c FROM mg WHERE v = p.b)) / 2) ** 2"}[metric]
    return f"""
r AS (SELECT unit, rater, {value} AS v, count(*) OVER (PARTITION BY unit) AS m FROM {source}),
co AS (SELECT x.v AS a, y.v AS b, sum(1.0::DOUBLE / (x.m - 1)) AS o FROM r x JOIN r y ON x.unit = y.unit AND x.rater <> y.rater GROUP BY 1, 2),
mg AS (SELECT a AS v, sum(o) AS c FROM co GROUP BY 1), tot AS (SELECT sum(c) AS n FROM mg),
p AS (SELECT x.v AS a, y.v AS b, x.c * y.c AS e, coalesce((SELECT o FROM co WHERE co.a = x.v AND co.b = y.v), 0) AS o FROM mg x JOIN mg y ON x.v <> y.v),
s AS (SELECT sum(p.o * {delta}) / (SELECT n FROM tot) AS d_o, sum(p.e * {delta}) / ((SELECT n FROM tot) * ((SELECT n FROM tot) - 1)) AS d_e FROM p)
SELECT round(1 - d_o / d_e, 6) AS {name}, (SELECT count(DISTINCT unit) FROM r WHERE m >= 2) AS units FROM s"""


def counted(t, value="level", k=K, visible=False):
    rows = t.ratings.where("hidden = 0") if visible else t.ratings
    return A.unit_counts(rows, UNIT, value, list(range(k)))


def alpha_query(counts, k, metric, name):
    return A.coincidences(counts, k).select(F.round(A.alpha(k, metric), 6).alias(name), "units")


@query("g06_alpha_ordinal", "ratings", pair_alpha_sql("ratings", "level", "ordinal", "alpha"))
def alpha_ordinal(t):
    return alpha_query(counted(t), K, "ordinal", "alpha")


@query("g06_alpha_interval", "ratings", pair_alpha_sql("ratings", "level", "interval", "alpha"))
def alpha_interval(t):
    return alpha_query(counted(t), K, "interval", "alpha")


@query("g07_severity_alpha", "ratings", "vis AS (SELECT * FROM ratings WHERE hidden = 0)," + pair_alpha_sql("vis", "level", "ordinal", "severity_alpha"))
def severity_alpha(t):
    return alpha_query(counted(t, visible=True), K, "ordinal", "severity_alpha")


@query("g07_state_alpha", "ratings", pair_alpha_sql("ratings", "CASE WHEN hidden = 1 THEN 4 ELSE level END", "nominal", "state_alpha"))
def state_alpha(t):
    state = t.ratings.withColumn("state", F.when(F.col("hidden") == 1, 4).otherwise(F.col("level")))
    return alpha_query(A.unit_counts(state, UNIT, "state", list(range(5))), 5, "nominal", "state_alpha")


@query("g07_visibility_alpha", "ratings", pair_alpha_sql("ratings", "hidden", "nominal", "visibility_alpha"))
def visibility_alpha(t):
    return alpha_query(A.unit_counts(t.ratings, UNIT, "hidden", [0, 1]), 2, "nominal", "visibility_alpha")


@query("g08_percent_agreement", "ratings", """
SELECT round(avg(CAST(x.level = y.level AS INTEGER)), 6) AS agreement, count(*) AS pairs FROM ratings x JOIN ratings y ON x.unit = y.unit AND x.rater < y.rater""")
def percent_agreement(t):
    return counted(t).agg(F.round(A.percent_agreement(K), 6).alias("agreement"), (F.sum(F.col("m") * (F.col("m") - 1)) / 2).cast("bigint").alias("pairs"))


@query("g09_grade_confusion", "ratings", """
SELECT least(x.level, y.level) AS a, greatest(x.level, y.level) AS b, count(*) AS pairs FROM ratings x JOIN ratings y ON x.unit = y.unit AND x.rater < y.rater GROUP BY 1, 2""")
def grade_confusion(t):
    return A.confusion(counted(t), K)


@query("g09_unanimous_and_adjudication", "ratings", N_SQL + """
SELECT unit, greatest(n0, n1, n2, n3) = m AS unanimous, m >= 3 AND greatest(n0, n1, n2, n3) = 1 AS needs_adjudication FROM n WHERE m >= 2""")
def unanimity(t):
    top = F.greatest("n0", "n1", "n2", "n3")
    return counted(t).where("m >= 2").select("unit", (top == F.col("m")).alias("unanimous"), ((F.col("m") >= 3) & (top == 1)).alias("needs_adjudication"))


@query("g10_consensus", "ratings", """
g AS (SELECT unit, count(*) AS total, list_sort(list(level) FILTER (WHERE hidden = 0)) AS seen, list_sort(list(level)) AS lv FROM ratings GROUP BY 1),
h AS (SELECT *, [v for v in [0, 1, 2, 3] if len([x for x in lv if x = v]) * 2 > len(lv)] AS maj FROM g)
SELECT unit, CASE WHEN coalesce(len(seen), 0) > 0 AND len(seen) * 2 >= total THEN seen[(len(seen) - 1) // 2 + 1] ELSE -1 END AS state,
 CASE WHEN len(maj) > 0 THEN maj[1] ELSE lv[(len(lv) - 1) // 2 + 1] END AS grade FROM h""")
def consensus(t):
    visible = counted(t, visible=True).withColumn("median", A.lower_median_index(K)).select("unit", F.col("m").alias("seen"), "median")
    grades = counted(t).select("unit", "m", A.majority_index(K).alias("grade"))
    state = F.when(F.coalesce(F.col("seen") * 2 >= F.col("m"), F.lit(False)), F.col("median")).otherwise(-1)
    return grades.join(visible, "unit", "left").select("unit", state.alias("state"), "grade")


@query("g11_panel_checks", "ratings", """
g AS (SELECT unit, count(*) AS m, count_if(hidden = 1) AS h FROM ratings GROUP BY 1),
c AS (SELECT 'units_with_two_raters' AS check_name, avg(CAST(m >= 2 AS INTEGER)) AS value, 0.3 AS threshold, 'above' AS direction FROM g
 UNION ALL SELECT 'hidden_share', sum(h) / sum(m), 0.25, 'below' FROM g UNION ALL SELECT 'mean_raters', avg(m), 2.0, 'above' FROM g)
SELECT check_name, round(value, 6) AS value, threshold::DOUBLE AS threshold, CASE direction WHEN 'above' THEN value >= threshold ELSE value <= threshold END AS passed FROM c""")
def panel_checks(t):
    from ..operators.intervals import gate_passed
    g = t.ratings.groupBy("unit").agg(F.count("*").alias("m"), F.sum("hidden").alias("h"))
    row = g.agg(F.avg((F.col("m") >= 2).cast("int")).alias("a"), (F.sum("h") / F.sum("m")).alias("b"), F.avg("m").alias("c"))
    checks = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(v).alias("value"), F.lit(th).alias("threshold"), F.lit(d).alias("direction"))
                       for n, v, th, d in (("units_with_two_raters", "a", 0.3, "above"), ("hidden_share", "b", 0.25, "below"), ("mean_raters", "c", 2.0, "above"))])
    out = row.select(F.inline(checks))
    return out.select("check_name", F.round("value", 6).alias("value"), "threshold", gate_passed(F.col("value"), F.col("threshold"), F.col("direction")).alias("passed"))


@query("g11_state_shares", "ratings", """
SELECT state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(count(*) / nullif(sum(CASE WHEN state <> 4 THEN count(*) END) OVER (), 0), 6) AS share_of_visible
FROM (SELECT CASE WHEN hidden = 1 THEN 4 ELSE level END AS state FROM ratings) GROUP BY 1""")
def state_shares(t):
    state = t.ratings.groupBy(F.when(F.col("hidden") == 1, 4).otherwise(F.col("level")).alias("state")).agg(F.count("*").alias("n"))
    totals = state.agg(F.sum("n").alias("all_n"), F.sum(F.when(F.col("state") != 4, F.col("n"))).alias("seen_n"))
    j = R.with_row(state, totals, "all_n", "seen_n")
    return j.select("state", "n", F.round(F.col("n") / F.col("all_n"), 6).alias("share"), F.round(F.col("n") / F.col("seen_n"), 6).alias("share_of_visible"))


@query("g11_rubric_drift", "ratings", """
SELECT rubric, count(DISTINCT vehicle) AS vehicles, rubric <> 'v1' AS drifted FROM (SELECT vehicle, CASE WHEN seq % 50 = 0 THEN 'v0' ELSE 'v1' END AS rubric FROM ratings) GROUP BY 1""")
def rubric_drift(t):
    rows = t.ratings.select("vehicle", F.when(F.col("seq") % 50 == 0, "v0").otherwise("v1").alias("rubric"))
    return rows.groupBy("rubric").agg(F.count_distinct("vehicle").alias("vehicles")).withColumn("drifted", F.col("rubric") != "v1")


@query("g12_leave_one_rater_out", "ratings", """
h AS (SELECT x.unit, x.rater, x.level AS held, y.level, count(*) AS n, min(y.seq) AS s FROM ratings x JOIN ratings y ON x.unit = y.unit AND x.rater <> y.rater GROUP BY ALL),
b AS (SELECT unit, rater, any_value(held) AS held, arg_max(level, {'n': n, 's': -s}) AS maj FROM h GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(CAST(held = maj AS INTEGER)), 6) AS exact, round(avg(CAST(abs(held - maj) <= 1 AS INTEGER)), 6) AS within_one FROM b""")
def leave_one_rater_out(t):
    out = A.leave_one_out(t.ratings, UNIT, "level", "seq", K)
    return out.select("n", F.round("exact", 6).alias("exact"), F.round("within_one", 6).alias("within_one"))


@query("g14_retest_stability", "ratings", """
n AS (SELECT unit, count(*) AS m, avg(level) AS mu, stddev_samp(level) AS sd, count_if(hidden = 1) AS h, stddev_samp(ln(1 + level / 10.0::DOUBLE)) AS sl FROM ratings GROUP BY unit HAVING count(*) >= 2),
p AS (SELECT avg(CAST(x.level <> y.level AS INTEGER)) AS dis FROM ratings x JOIN ratings y ON x.unit = y.unit AND x.rater < y.rater)
SELECT count(*) AS units, round(avg(CASE WHEN mu > 0 THEN sd / mu END), 6) AS mean_cv, round((SELECT dis FROM p), 6) AS severity_disagreement,
 round(avg(CAST(h > 0 AND h < m AS INTEGER)), 6) AS presence_instability, round(avg(sl), 6) AS sd_log_multiplier FROM n""")
def retest(t):
    rows = t.ratings
    g = rows.groupBy("unit").agg(F.count("*").alias("m"), F.avg("level").alias("mu"), F.stddev_samp("level").alias("sd"), F.sum("hidden").alias("h"),
                                 F.stddev_samp(F.log(1 + F.col("level") / 10.0)).alias("sl")).where("m >= 2")
    c = counted(t).agg(A.percent_agreement(K).alias("same"))
    out = g.agg(F.count("*").alias("units"), F.round(F.avg(F.when(F.col("mu") > 0, F.col("sd") / F.col("mu"))), 6).alias("mean_cv"),
                F.round(F.avg(((F.col("h") > 0) & (F.col("h") < F.col("m"))).cast("int")), 6).alias("presence_instability"),
                F.round(F.avg("sl"), 6).alias("sd_log_multiplier"))
    return R.with_row(out, c, "same").withColumn("severity_disagreement", F.round(1 - F.col("same"), 6)).drop("same")
