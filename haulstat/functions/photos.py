"""Column rules for photo rows: integrity, capture quality, verdicts, boxes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.ranking import first_true

# Integrity limits, quality weights, view sets, subject-score weights.
MIN_SIDE, MIN_PIXELS, ASPECT = 200, 120000, (0.3, 3.5)
QUALITY_WEIGHTS = {"sharp": 0.36, "exposure": 0.22, "clipping": 0.18, "contrast": 0.14, "size": 0.10}
ONLINE_CUTS = (0.70, 0.88)
CAPTURE_FLOORS = {"blur_floor": 34.0, "blur_warn": 122.4, "brightness_floor": 0.0824,
                  "brightness_ceiling": 0.7514, "contrast_floor": 0.0858,
                  "dark_ceiling": 0.6384, "bright_ceiling": 0.1727}
WHOLE_VIEWS = ["exterior_front_34", "exterior_side", "exterior_front", "exterior_rear"]


def drop_reason(width: Column, height: Column) -> Column:
    """First integrity rule a photo fails, NULL when it passes."""
    ratio = width / height
    return first_true([
        (width.isNull() | height.isNull(), "drop_corrupt"),
        ((F.least(width, height) < MIN_SIDE) | (width.cast("bigint") * height < MIN_PIXELS), "drop_too_small"),
        (~ratio.between(*ASPECT), "drop_aspect")])


def capture_quality(blur: Column, brightness: Column, dark: Column, bright: Column,
                    contrast: Column, width: Column, height: Column) -> Column:
    one = F.lit(1.0)
    terms = {"sharp": F.least(one, F.log1p(blur) / F.log1p(F.lit(1200.0))),
             "exposure": one - F.least(one, F.abs(brightness - 0.45) / 0.45),
             "clipping": one - F.least(one, (dark + bright) * 4),
             "contrast": F.least(one, contrast / 0.25),
             "size": F.least(one, width * height / F.lit(1600.0 * 1200.0))}
    return F.bround(sum(QUALITY_WEIGHTS[k] * v for k, v in terms.items()), 4)


def quality_bucket(score: Column, low, high) -> Column:
    return F.when(score <= low, "poor").when(score <= high, "fair").otherwise("good")


def capture_reasons(blur, brightness, contrast, dark, bright, limits=CAPTURE_FLOORS) -> Column:
    """Every capture problem of a photo, in a fixed order."""
    found = F.array(
        F.when(blur < limits["blur_floor"], "blurry").when(blur < limits["blur_warn"], "soft_focus"),
        F.when((brightness < limits["brightness_floor"]) | (dark > limits["dark_ceiling"]), "underexposed"),
        F.when((brightness > limits["brightness_ceiling"]) | (bright > limits["bright_ceiling"]), "blown_out"),
        F.when(contrast < limits["contrast_floor"], "flat"))
    return F.filter(found, lambda r: r.isNotNull())


def usable(reasons: Column) -> Column:
    """Soft focus only warns; any other reason makes the photo unusable."""
    return F.size(F.array_except(reasons, F.array(F.lit("soft_focus")))) == 0


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes; an unreadable hash gives 64."""
    def half(x: Column, at: int) -> Column:
        return F.conv(F.substring(x, at, 8), 16, 10).cast("bigint")

    readable = F.coalesce(a.rlike("^[0-9a-f]{16}$") & b.rlike("^[0-9a-f]{16}$"), F.lit(False))
    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    return F.when(readable, bits).otherwise(64)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two (x1, y1, x2, y2) boxes."""
    ix = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    iy = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = ix * iy

    def area(z):
        return F.abs((z[2] - z[0]) * (z[3] - z[1]))

    union = area(a) + area(b) - inter
    return F.when((inter <= 0) | (union <= 0), 0.0).otherwise(inter / union)
