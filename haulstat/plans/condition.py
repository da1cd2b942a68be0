"""Condition queries: coverage, families, roll-up, grade, multiplier."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import condition as FC
from ..operators import condition as C
from .registry import query

V = ["listing_id"]


def values(rows):
    return ",".join("(" + ",".join(repr(x) for x in r) + ")" for r in rows)


LEVELS_SQL = "lv(view, family, level) AS (VALUES " + values(
    [(v, f, lv) for f, (a, b) in FC.FAMILY_VIEWS.items() for vs, lv in ((a, 1.0), (b, 0.5)) for v in vs]) + ")"
FAMILIES_SQL = "fm(family, component, weight) AS (VALUES " + values([(f, c, w) for f, (w, cs) in FC.FAMILIES.items() for c in cs]) + ")"
COVER_SQL = LEVELS_SQL + """,
cov AS (SELECT listing_id, family, max(level)::DOUBLE AS seen, bool_or(affirmed) AS affirmed FROM (SELECT listing_id, view, bool_or(affirmed) AS affirmed FROM reads WHERE error = '' AND legible GROUP BY 1, 2) JOIN lv USING (view) GROUP BY 1, 2)"""
DEMERIT_SQL = FAMILIES_SQL + """,
fd AS (SELECT f.*, coalesce(fm.family, 'other') AS family, CASE severity WHEN 'cosmetic' THEN 0 WHEN 'minor' THEN 1 WHEN 'moderate' THEN 2 WHEN 'major' THEN 3 END AS sr,
  CASE price_impact WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS ir,
  CASE WHEN ungraded THEN 0.0::DOUBLE ELSE coalesce([0.15, 0.4, 1.0, 2.2][sr + 1]::DOUBLE * [0.0, 0.4, 1.0, 2.0][ir + 1]::DOUBLE * greatest(0.2, least(1.0, coalesce(confidence, 0.3))), 0.0) END AS v
 FROM findings f LEFT JOIN fm USING (component)),
fr AS (SELECT *, row_number() OVER (PARTITION BY listing_id, family ORDER BY v DESC) - 1 AS k FROM fd),
fam AS (SELECT listing_id, family, count(*) AS n_findings, ['cosmetic','minor','moderate','major'][1 + max(CASE WHEN NOT ungraded THEN sr END)] AS worst,
  round(least(4.4, sum(v * 0.4::DOUBLE ** k)), 4) AS demerit FROM fr GROUP BY 1, 2)"""
ROLL_SQL = COVER_SQL + "," + DEMERIT_SQL + """,
roll AS (SELECT coalesce(f.listing_id, c.listing_id) AS listing_id, coalesce(f.family, c.family) AS family, coalesce(n_findings, 0) AS n_findings, worst, coalesce(demerit, 0) AS demerit,
  coalesce(seen, 0) AS seen, CASE WHEN n_findings IS NULL THEN least(CASE WHEN affirmed THEN 1.0 ELSE 0.5 END, seen) ELSE 0 END AS credit,
  coalesce((SELECT max(weight) FROM fm WHERE fm.family = coalesce(f.family, c.family)), 0)::DOUBLE AS weight
 FROM fam f FULL JOIN cov c ON f.listing_id = c.listing_id AND f.family = c.family),
tot AS (SELECT listing_id, round(sum(demerit), 4) AS demerit, round(max(demerit), 4) AS worst_family, round(sum(weight * seen), 4) AS coverage, round(sum(weight * credit), 4) AS merit FROM roll GROUP BY 1),
flg AS (SELECT listing_id, count(*) AS n_findings, bool_or(q AND sr >= 3) AS has_major, bool_or(q AND sr >= 2) AS has_moderate, bool_or(NOT ungraded AND (coalesce(sr, 0) > 0 OR ir >= 2)) AS above
 FROM (SELECT *, NOT ungraded AND ir >= 2 AND (coalesce(confidence, 0) >= 0.75 OR seen_twice) AS q FROM fd) GROUP BY 1),
rd AS (SELECT listing_id, count_if(error = '') AS photos_read FROM reads GROUP BY 1),
v AS (SELECT listing_id, coalesce(demerit, 0) AS demerit, coalesce(worst_family, 0) AS worst_family, coalesce(coverage, 0) AS coverage, coalesce(merit, 0) AS merit, coalesce(n_findings, 0) AS n_findings,
  coalesce(has_major, false) AS has_major, coalesce(has_moderate, false) AS has_moderate, coalesce(above, false) AS above, coalesce(photos_read, 0) AS photos_read,
  greatest(0.0, least(1.0, (coalesce(coverage, 0) - 0.6) / (0.85::DOUBLE - 0.6::DOUBLE))) AS gate FROM tot FULL JOIN flg USING (listing_id) FULL JOIN rd USING (listing_id)),
g AS (SELECT *, CASE WHEN photos_read <= 0 OR coverage < 0.35 THEN 'unknown' WHEN has_major OR demerit >= 6 THEN 'poor' WHEN has_moderate OR demerit >= 1.8 THEN 'fair'
  WHEN coverage >= 0.75 AND merit * gate >= 0.55 AND demerit <= 0.25 AND NOT above THEN 'excellent' ELSE 'good' END AS grade FROM v),
n AS (SELECT *, CASE WHEN grade <> 'excellent' THEN -demerit / 4 ELSE greatest(0.0, (merit * gate - 0.55) / 0.45) * CASE WHEN has_moderate THEN 0 ELSE greatest(0.0, 1 - worst_family) END END AS net FROM g)"""


@query("d20_view_coverage", "reads", COVER_SQL + " SELECT listing_id, family, seen, affirmed FROM cov")
def view_coverage(t):
    return C.family_coverage(t.reads, V)


@query("d20_component_frames", "reads", LEVELS_SQL + "," + FAMILIES_SQL + """
SELECT listing_id, component, CAST(count(*) AS BIGINT) AS frames FROM reads JOIN lv USING (view) JOIN fm USING (family) WHERE error = '' AND level = 1.0 GROUP BY 1, 2""")
def component_frames(t):
    return C.component_frames(t.reads, V)


@query("f09_family_saturation", "findings", DEMERIT_SQL + " SELECT listing_id, family, n_findings, worst, demerit FROM fam")
def family_saturation(t):
    return C.family_demerits(t.findings, V)


@query("f10_vehicle_rollup", "findings reads", ROLL_SQL + " SELECT listing_id, demerit, worst_family, coverage, merit, photos_read FROM v")
def vehicle_rollup(t):
    return C.vehicle_rollup(t.findings, t.reads, V).select("listing_id", "demerit", "worst_family", "coverage", "merit", "photos_read")


@query("f11_grade_ladder", "findings reads", ROLL_SQL + """
SELECT listing_id, grade, CASE WHEN photos_read <= 0 THEN 'no_photo_read' WHEN coverage < 0.35 THEN 'thin_coverage' WHEN has_major THEN 'major_finding' WHEN demerit >= 6 THEN 'total_demerit'
 WHEN has_moderate THEN 'moderate_finding' WHEN demerit >= 1.8 THEN 'total_demerit' WHEN grade = 'excellent' THEN 'affirmed_sound' WHEN n_findings = 0 THEN 'not_affirmed' ELSE 'minor_only' END AS grade_rule FROM g""")
def grade_ladder(t):
    return C.vehicle_rollup(t.findings, t.reads, V).select("listing_id", "grade", "grade_rule")


@query("f12_condition_multiplier", "findings reads", ROLL_SQL + """
SELECT listing_id, round(net, 6) AS net_score, round(1 + (1 - exp(-0.0551::DOUBLE)) * tanh(net), 4) AS multiplier FROM n""")
def condition_multiplier(t):
    df = C.vehicle_rollup(t.findings, t.reads, V).withColumns(C.multiplier_columns(0.0551))
    return df.select("listing_id", F.round("net_score", 6).alias("net_score"), "multiplier")


@query("f13_band_widening", "findings reads", ROLL_SQL + """
SELECT listing_id, round(CASE WHEN n_findings = 0 AND coverage <= 0 THEN 1 ELSE least(1.5, greatest(1.0, (1 + 0.35 * (1 - least(1, greatest(0, coverage)))) *
 CASE abs(1 - CASE grade WHEN 'poor' THEN 0 WHEN 'fair' THEN 1 WHEN 'good' THEN 2 WHEN 'excellent' THEN 3 END) WHEN 1 THEN 1.08 WHEN 2 THEN 1.2 WHEN 3 THEN 1.2 ELSE 1 END)) END, 4) AS widening FROM g""")
def band_widening(t):
    df = C.vehicle_rollup(t.findings, t.reads, V)
    return df.select("listing_id", F.round(C.band_widening(F.lit("fair")), 4).alias("widening"))


@query("l03_worst_families", "findings", DEMERIT_SQL + """
SELECT listing_id, array_to_string(list_transform_x, '|') AS worst_five FROM (SELECT listing_id, [x.family for x in list_sort(list({'d': -demerit, 'family': family}))[1:5]] AS list_transform_x FROM fam WHERE demerit > 0 GROUP BY 1)""")
def worst_families(t):
    fam = C.family_demerits(t.findings, V).where("demerit > 0")
    worst = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("demerit")).alias("d"), "family"))), 1, 5)
    return fam.groupBy("listing_id").agg(F.array_join(F.transform(worst, lambda x: x["family"]), "|").alias("worst_five"))
