"""Weights and ladders that turn graded findings into a condition."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal scales, weights, families and their views, ladder thresholds.
SEVERITIES = ["cosmetic", "minor", "moderate", "major"]
IMPACTS = ["none", "low", "medium", "high"]
GRADES = ["poor", "fair", "good", "excellent"]
SEVERITY_WEIGHT = {"cosmetic": 0.15, "minor": 0.40, "moderate": 1.00, "major": 2.20}
IMPACT_WEIGHT = {"none": 0.0, "low": 0.40, "medium": 1.00, "high": 2.00}
CONFIDENCE_FLOOR, CONFIDENCE_UNREADABLE, QUALIFIED_CONFIDENCE = 0.2, 0.3, 0.75
DECAY, FAMILY_CAP = 0.40, 4.40
DEMERIT_SCALE, MERIT_BLOCK = 4.0, 1.0
COVER_MIN, COVER_GOOD, COVER_UNGRADED, COVER_EXCELLENT = 0.60, 0.85, 0.35, 0.75
MERIT_EXCELLENT, DEMERIT_EXCELLENT, DEMERIT_FAIR, DEMERIT_POOR = 0.55, 0.25, 1.8, 6.0
FAMILIES = {
    "steer_tires": (0.07, ["steer_tires"]),
    "drive_tires": (0.10, ["drive_tires"]),
    "wheels_hubs": (0.05, ["wheels_rims", "brakes_hubs"]),
    "fifth_wheel": (0.08, ["fifth_wheel", "coupling_airlines"]),
    "frame_corrosion": (0.14, ["chassis_frame", "undercarriage", "corrosion"]),
    "suspension_air": (0.07, ["air_suspension", "air_tanks_lines"]),
    "body_panels": (0.09, ["cab_exterior_panels", "front_bumper_valance", "fairings_skirts",
                           "doors_handles", "roof_deflector", "paint_finish"]),
    "steps_guards": (0.02, ["cab_steps", "mudflaps_guards"]),
    "glass_lights": (0.05, ["windscreen_glass", "grille_headlights", "mirrors_visor"]),
    "tanks": (0.04, ["fuel_tank", "adblue_tank"]),
    "engine_leaks": (0.15, ["engine_bay", "fluid_leaks", "exhaust_dpf"]),
    "cab_seats_trim": (0.05, ["cab_interior_seats", "bunk_sleeper", "cab_floor_trim"]),
    "cab_controls": (0.04, ["steering_wheel_controls", "dashboard_instruments"]),
    "warning_lights": (0.05, ["warning_lights"]),
}
FAMILY_VIEWS = {
    "steer_tires": (["tire_wheel"], ["exterior_side", "exterior_front_34", "exterior_front", "exterior_rear"]),
    "drive_tires": (["tire_wheel"], ["exterior_side", "exterior_front_34", "exterior_front", "exterior_rear"]),
    "wheels_hubs": (["tire_wheel"], ["exterior_side", "exterior_front_34", "exterior_front", "exterior_rear"]),
    "fifth_wheel": (["fifth_wheel"], ["exterior_rear", "chassis_undercarriage"]),
    "frame_corrosion": (["chassis_undercarriage"], ["exterior_side", "exterior_rear"]),
    "suspension_air": (["chassis_undercarriage"], ["tire_wheel"]),
    "body_panels": (["exterior_side", "exterior_front_34"], ["exterior_front", "exterior_rear"]),
    "steps_guards": (["exterior_side"], ["exterior_front_34", "exterior_rear"]),
    "glass_lights": (["exterior_front", "exterior_front_34"], ["interior_cab"]),
    "tanks": (["exterior_side"], ["chassis_undercarriage", "exterior_front_34"]),
    "engine_leaks": (["engine_bay"], ["chassis_undercarriage"]),
    "cab_seats_trim": (["interior_cab"], []),
    "cab_controls": (["dashboard_odometer"], ["interior_cab"]),
    "warning_lights": (["dashboard_odometer"], ["interior_cab"]),
}
OTHER_FAMILY = "other"


def lookup(table: dict, key: Column) -> Column:
    """Value of a fixed table, NULL for an unknown key."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def rank_of(scale: list[str], level: Column) -> Column:
    return lookup({name: i for i, name in enumerate(scale)}, level)


def level_of(scale: list[str], rank: Column) -> Column:
    # element_at reads a NULL index over a constant array as -1, so the NULL is kept by hand.
    return F.when(rank.isNotNull(), F.element_at(F.array(*[F.lit(s) for s in scale]), (rank + 1).cast("int")))


def family_of(component: Column) -> Column:
    table = {c: f for f, (_, members) in FAMILIES.items() for c in members}
    return F.coalesce(lookup(table, component), F.lit(OTHER_FAMILY))


def demerit(severity: Column, impact: Column, confidence: Column, ungraded: Column) -> Column:
    """Severity x impact x clamped confidence; anything unreadable weighs nothing."""
    readable = F.when(confidence.isNull() | F.isnan(confidence), CONFIDENCE_UNREADABLE).otherwise(confidence)
    value = (lookup(SEVERITY_WEIGHT, severity) * lookup(IMPACT_WEIGHT, impact)
             * F.greatest(F.lit(CONFIDENCE_FLOOR), F.least(F.lit(1.0), readable)))
    return F.when(ungraded, 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def qualified(severity: Column, impact: Column, confidence: Column, ungraded: Column,
              seen_again: Column, rank: int) -> Column:
    """A finding strong enough to set a grade alone."""
    sure = F.when(confidence.isNull() | F.isnan(confidence), 0.0).otherwise(confidence) >= QUALIFIED_CONFIDENCE
    return F.coalesce(~ungraded & (rank_of(SEVERITIES, severity) >= rank)
                      & (rank_of(IMPACTS, impact) >= IMPACTS.index("medium")) & (sure | seen_again), F.lit(False))


def coverage_gate(coverage: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (coverage - COVER_MIN) / (COVER_GOOD - COVER_MIN)))
