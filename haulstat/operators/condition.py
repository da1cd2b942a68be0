"""From findings and reads to families, one vehicle roll-up, a grade and a price multiplier."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import condition as C
from ..session import small_table


def families_frame(spark) -> DataFrame:
    """The fixed family table: 14 rows with their weight."""
    return small_table(spark, [(f, w) for f, (w, _) in C.FAMILIES.items()], ["family", "weight"])


def view_levels(spark) -> DataFrame:
    """Fixed (view, family, level): 1.0 where the view shows the family well, 0.5 where it glimpses it."""
    rows = [(v, f, level) for f, (main, side) in C.FAMILY_VIEWS.items() for vs, level in ((main, 1.0), (side, 0.5)) for v in vs]
    return small_table(spark, rows, ["view", "family", "level"])


def family_coverage(reads: DataFrame, unit: list[str]) -> DataFrame:
    """Per unit and family: best level seen in a legible read, and whether a read affirmed it."""
    legible = reads.where("error = '' and legible")
    views = legible.groupBy(*unit, "view").agg(F.bool_or("affirmed").alias("affirmed"))
    return views.join(view_levels(reads.sparkSession), "view").groupBy(*unit, "family").agg(
        F.max("level").alias("seen"), F.bool_or("affirmed").alias("affirmed"))


def component_frames(reads: DataFrame, unit: list[str]) -> DataFrame:
    """How many read frames should show each component (the denominator of a sighting)."""
    rows = [(f, c) for f, (_, members) in C.FAMILIES.items() for c in members]
    members = small_table(reads.sparkSession, rows, ["family", "component"])
    counted = reads.where("error = ''").groupBy(*unit, "view").agg(F.count("*").alias("_n"))
    return (counted.join(view_levels(reads.sparkSession).where("level = 1.0"), "view").join(members, "family")
            .groupBy(*unit, "component").agg(F.sum("_n").alias("frames")))


def family_demerits(findings: DataFrame, unit: list[str]) -> DataFrame:
    """Demerit per unit and family: the worst counts in full, each further one decays, capped.

    Equal demerits are counted first. A value of n findings behind r worse ones
    adds v * d^r * (1 - d^n) / (1 - d), so every finding counts and no list is built.
    """
    value = C.demerit(F.col("severity"), F.col("price_impact"), F.col("confidence"), F.col("ungraded"))
    tagged = findings.withColumns({"family": C.family_of(F.col("component")), "_v": value})
    counted = tagged.groupBy(*unit, "family", "_v").agg(
        F.count("*").alias("_n"), F.max(F.when(~F.col("ungraded"), C.rank_of(C.SEVERITIES, F.col("severity")))).alias("_worst"))
    worse = W.partitionBy(*unit, "family").orderBy(F.col("_v").desc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("_r", F.coalesce(F.sum("_n").over(worse), F.lit(0)))
    decay = F.lit(C.DECAY)
    part = F.when(F.col("_v") > 0, F.col("_v") * F.pow(decay, F.col("_r")) * (1 - F.pow(decay, F.col("_n"))) / (1 - decay))
    total = F.least(F.lit(C.FAMILY_CAP), F.coalesce(F.sum(part), F.lit(0.0)))
    return placed.groupBy(*unit, "family").agg(F.sum("_n").alias("n_findings"), C.level_of(C.SEVERITIES, F.max("_worst")).alias("worst"),
                                               F.round(total, 4).alias("demerit"))


def family_rollup(findings: DataFrame, reads: DataFrame, unit: list[str]) -> DataFrame:
    """One row per unit and family that was seen or carries a finding."""
    seen = family_coverage(reads, unit)
    found = family_demerits(findings, unit)
    both = found.join(seen, unit + ["family"], "full_outer").join(families_frame(findings.sparkSession), "family", "left")
    level = F.when(F.col("family") == C.OTHER_FAMILY, 0.0).otherwise(F.coalesce("seen", F.lit(0.0)))
    clean = F.col("n_findings").isNull()
    credit = F.when(clean, F.least(F.when(F.coalesce("affirmed", F.lit(False)), 1.0).otherwise(0.5), F.col("seen"))).otherwise(0.0)
    return both.select(*unit, "family", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), "worst",
                       F.coalesce("demerit", F.lit(0.0)).alias("demerit"), level.alias("seen"), credit.alias("credit"),
                       F.coalesce("weight", F.lit(0.0)).alias("weight"))


def vehicle_rollup(findings: DataFrame, reads: DataFrame, unit: list[str]) -> DataFrame:
    """One row per unit: totals, grade with the rule that decided it, multiplier inputs."""
    families = family_rollup(findings, reads, unit)
    totals = families.groupBy(*unit).agg(
        F.round(F.sum("demerit"), 4).alias("demerit"), F.round(F.max("demerit"), 4).alias("worst_family"),
        F.round(F.sum(F.col("weight") * F.col("seen")), 4).alias("coverage"),
        F.round(F.sum(F.col("weight") * F.col("credit")), 4).alias("merit"),
        F.count_if(F.col("n_findings") > 0).alias("families_hit"))
    q = lambda rank: F.bool_or(C.qualified(F.col("severity"), F.col("price_impact"), F.col("confidence"),
                                           F.col("ungraded"), F.col("seen_twice"), rank))
    above = ~F.col("ungraded") & ((F.coalesce(C.rank_of(C.SEVERITIES, F.col("severity")), F.lit(0)) > 0)
                                  | (F.coalesce(C.rank_of(C.IMPACTS, F.col("price_impact")), F.lit(0)) >= 2))
    flags = findings.groupBy(*unit).agg(q(3).alias("has_major"), q(2).alias("has_moderate"), F.bool_or(above).alias("above_cosmetic"),
                                        F.count_if("ungraded").alias("ungraded"), F.count("*").alias("n_findings"))
    photos = reads.groupBy(*unit).agg(F.count_if(F.col("error") == "").alias("photos_read"))
    df = totals.join(flags, unit, "full_outer").join(photos, unit, "full_outer")
    df = df.na.fill(0).na.fill(False, ["has_major", "has_moderate", "above_cosmetic"])
    return df.withColumns(grade_columns())


def grade_columns() -> dict[str, Column]:
    """The ladder in order: the first rule that holds names the grade."""
    c = F.col
    gated = c("merit") * C.coverage_gate(c("coverage"))
    excellent = ((c("coverage") >= C.COVER_EXCELLENT) & (gated >= C.MERIT_EXCELLENT)
                 & (c("demerit") <= C.DEMERIT_EXCELLENT) & ~c("above_cosmetic"))
    ladder = [(c("photos_read") <= 0, "unknown", "no_photo_read"), (c("coverage") < C.COVER_UNGRADED, "unknown", "thin_coverage"),
              (c("has_major"), "poor", "major_finding"), (c("demerit") >= C.DEMERIT_POOR, "poor", "total_demerit"),
              (c("has_moderate"), "fair", "moderate_finding"), (c("demerit") >= C.DEMERIT_FAIR, "fair", "total_demerit"),
              (excellent, "excellent", "affirmed_sound"), (c("n_findings") == 0, "good", "not_affirmed")]
    grade, reason = None, None
    for cond, g, r in ladder:
        grade = F.when(cond, g) if grade is None else grade.when(cond, g)
        reason = F.when(cond, r) if reason is None else reason.when(cond, r)
    return {"grade": grade.otherwise("good"), "grade_rule": reason.otherwise("minor_only")}


def multiplier_columns(sigma: float) -> dict[str, Column]:
    """Net score -> two-sided multiplier capped at one residual sd, in percent both ways."""
    import math
    c = F.col
    block = F.when(c("has_moderate"), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - c("worst_family") / C.MERIT_BLOCK))
    ramp = (c("merit") * C.coverage_gate(c("coverage")) - C.MERIT_EXCELLENT) / (1 - C.MERIT_EXCELLENT)
    net = F.when(c("grade") != "excellent", -c("demerit") / C.DEMERIT_SCALE).otherwise(F.greatest(F.lit(0.0), ramp) * block)
    return {"premium_block": block, "net_score": net,
            "multiplier": F.round(1 + (1 - math.exp(-sigma)) * F.tanh(net), 4)}


def band_widening(model_grade: Column, retest: float = 1.0) -> Column:
    """Coverage x grader disagreement x retest, at least 1.0 and at most 1.5."""
    c = F.col
    cover = 1 + 0.35 * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("coverage"))))
    steps = F.abs(C.rank_of(C.GRADES, model_grade) - C.rank_of(C.GRADES, c("grade")))
    apart = F.when(steps == 1, 1.08).when(steps >= 2, 1.20).otherwise(1.0)
    none = (c("n_findings") == 0) & (c("coverage") <= 0)
    return F.when(none, 1.0).otherwise(F.least(F.lit(1.5), F.greatest(F.lit(1.0), cover * apart * retest)))
