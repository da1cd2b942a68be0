"""Detected boxes: duplicates, dominance, subject choice, detector benchmarks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import photos as P
from . import clusters

# Labels that can be the subject, thresholds and score weights.
SUBJECT_LABELS = ["truck", "bus", "car"]
SAME_BOX = 0.70
LABEL_PRIOR = {"truck": 1.00, "bus": 0.92, "car": 0.55}
CONFIDENCE_FLOOR, CENTRE_BONUS, CENTRE_BIAS, EDGE_RELIEF, EDGE_PX, MATCH_FLOOR = 0.40, 1.35, 0.55, 0.18, 2.0, 0.30
MIN_TRUCK_AREA, MIN_SUBJECT_AREA, PART_VIEW_AREA, SCENERY_FOCUS = 0.12, 0.04, 0.9464, 0.55
FOLD_LIMIT = 200  # boxes of one photo that are folded inside one row


def box_iou(a: str, b: str) -> Column:
    return P.iou([F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(f"{b}.{c}") for c in ("x1", "y1", "x2", "y2")])


def same_box_pairs(boxes: DataFrame) -> DataFrame:
    """Pairs of subject boxes of one photo at IoU >= 0.70 (``first`` is the more confident).

    Such boxes differ in area by less than half an octave, so a box meets only
    those of its own and the neighbouring size class.
    """
    s = boxes.where(F.col("label").isin(*SUBJECT_LABELS)).withColumn(
        "_c", F.floor(F.log2(F.greatest(F.lit(1.0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))) / 0.52).cast("int"))
    near = s.withColumn("_c", F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1)))
    rank = lambda t: F.struct((-F.col(f"{t}.confidence")).alias("c"), F.col(f"{t}.box_id").alias("b"))
    a, b = s.alias("a"), near.alias("b")
    j = a.join(b, (F.col("a.photo_id") == F.col("b.photo_id")) & (F.col("a._c") == F.col("b._c"))).where(rank("a") < rank("b"))
    return j.where(box_iou("a", "b") >= SAME_BOX).select(F.col("a.photo_id").alias("photo_id"), F.col("a.box_id").alias("box_id"), F.col("b.box_id").alias("later_box"))


def dedupe_vehicles(boxes: DataFrame) -> DataFrame:
    """One box per physical vehicle, most confident first; other labels pass through.

    Photos with few boxes fold their own array; a photo with very many is
    settled in rounds over its similar pairs. Both give the greedy result.
    """
    subjects = boxes.where(F.col("label").isin(*SUBJECT_LABELS))
    others = boxes.where(~F.col("label").isin(*SUBJECT_LABELS)).select("photo_id", "box_id")
    sizes = subjects.groupBy("photo_id").agg(F.count("*").alias("_n"))
    tagged = subjects.join(sizes, "photo_id")
    item = F.struct((-F.col("confidence")).alias("c"), "box_id", "x1", "y1", "x2", "y2")
    packed = tagged.where(F.col("_n") <= FOLD_LIMIT).groupBy("photo_id").agg(F.array_sort(F.collect_list(item)).alias("all"))

    def overlaps(s, x):
        return P.iou([s["x1"], s["y1"], s["x2"], s["y2"]], [x["x1"], x["y1"], x["x2"], x["y2"]]) >= SAME_BOX

    fold = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda s: overlaps(s, x)), kept).otherwise(F.array_append(kept, x)))
    small = packed.select("photo_id", F.inline(fold)).select("photo_id", "box_id")
    big = tagged.where(F.col("_n") > FOLD_LIMIT)
    if not big.isEmpty():
        state = clusters.leaders(big, same_box_pairs(big), ["photo_id", "box_id"], {"photo_id": "photo_id", "box_id": "later_box"})
        small = small.unionByName(state.where("is_leader").select("photo_id", "box_id"))
    return small.unionByName(others)


def dominant(boxes: DataFrame, unit: list[str]) -> DataFrame:
    """Best truck confidence per photo: big enough and not smaller than a competing vehicle."""
    trucks = F.col("label").isin("truck", "bus")
    best = F.max(F.when(trucks, F.struct("confidence", F.col("area_frac").alias("a"))))
    rival = F.max(F.when(~trucks & (F.col("confidence") >= 0.5), F.col("area_frac")))
    biggest = F.max(F.when(F.col("label").isin(*SUBJECT_LABELS) & (F.col("confidence") >= 0.10), F.col("area_frac")))
    g = boxes.groupBy(*unit, "photo_id").agg(best.alias("b"), F.coalesce(rival, F.lit(0.0)).alias("rival"), F.coalesce(biggest, F.lit(0.0)).alias("biggest"))
    ok = (F.col("b.a") >= MIN_TRUCK_AREA) & (F.col("b.a") >= F.col("rival"))
    return g.select(*unit, "photo_id", F.when(F.coalesce(ok, F.lit(False)), F.col("b.confidence")).otherwise(0.0).alias("best"), "biggest")


def with_geometry(boxes: DataFrame, width: float, height: float) -> DataFrame:
    cx, cy = (F.col("x1") + F.col("x2")) / 2 / width, (F.col("y1") + F.col("y2")) / 2 / height
    far = F.least(F.lit(1.0), F.sqrt(F.pow(cx - 0.5, 2) + F.pow(cy - 0.5, 2)) / (0.5 * 2 ** 0.5))
    hit = F.lit(width / 2).between(F.col("x1"), F.col("x2")) & F.lit(height / 2).between(F.col("y1"), F.col("y2"))
    sides = [F.col("x1") <= EDGE_PX, F.col("y1") <= EDGE_PX, F.col("x2") >= width - EDGE_PX, F.col("y2") >= height - EDGE_PX]
    clipped = sum((s.cast("int") for s in sides[1:]), sides[0].cast("int"))
    return boxes.withColumns({"far": far, "centre_hit": hit, "clipped": clipped, "min_side": F.least(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))})


def frame_score(match: Column | None = None) -> Column:
    """What one photo thinks of one box: prior x confidence x root area x centre x edge x likeness."""
    prior = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABEL_PRIOR.items() for x in kv]), F.col("label")), F.lit(0.0))
    conf = CONFIDENCE_FLOOR + (1 - CONFIDENCE_FLOOR) * F.col("confidence")
    centre = F.when(F.col("centre_hit"), CENTRE_BONUS).otherwise(1 - CENTRE_BIAS * F.col("far"))
    edge = F.when(F.col("centre_hit"), 1 + EDGE_RELIEF * F.col("clipped")).otherwise(1.0)
    like = F.lit(1.0) if match is None else MATCH_FLOOR + (1 - MATCH_FLOOR) * match
    return prior * conf * F.sqrt(F.greatest(F.lit(0.0), F.col("area_frac"))) * centre * edge * like


def eligible(close_up: Column) -> Column:
    """Subject label, not scenery, and a car only where no truck or bus is in the frame."""
    small = F.col("area_frac") < MIN_SUBJECT_AREA
    blurred = (F.col("focus_ratio") < SCENERY_FOCUS) & (F.col("area_frac") < PART_VIEW_AREA)
    yard = close_up & (F.col("area_frac") < PART_VIEW_AREA)
    return F.col("label").isin(*SUBJECT_LABELS) & ~(small | blurred | yard) & ((F.col("label") != "car") | ~F.col("has_truck"))


def choose_subject(boxes: DataFrame, unit: list[str], match: Column) -> DataFrame:
    """Subject box per photo with the framing guard, and how many boxes compete with it.

    The likeness score may move the choice, but never from a box that holds the
    centre of the frame to one that does not.
    """
    keys = unit + ["photo_id"]
    flags = boxes.groupBy(*keys).agg(F.bool_or(F.col("label").isin("truck", "bus")).alias("has_truck"))
    pool = boxes.join(flags, keys)
    kept = pool.where(eligible(F.col("close_up"))).withColumns({"geo": F.round(frame_score(), 9), "full": F.round(frame_score(match), 9)})
    row = lambda s: F.max(F.struct(F.col(s).alias("s"), (-F.col("box_id")).alias("i"), "centre_hit", "box_id", "area_frac", F.col("full").alias("score")))
    best = kept.groupBy(*keys).agg(row("full").alias("f"), row("geo").alias("g"))
    guard = (F.col("f.box_id") != F.col("g.box_id")) & F.col("g.centre_hit") & ~F.col("f.centre_hit")
    pick = F.when(guard, F.col("g")).otherwise(F.col("f"))
    chosen = best.select(*keys, pick.alias("p"), guard.alias("kept_framing"))
    floor = F.greatest(F.lit(0.02), 0.08 * F.coalesce(F.col("p.area_frac"), F.lit(0.0)))
    rivals = boxes.join(chosen, keys, "left").where((F.col("confidence") >= 0.40) & (F.col("area_frac") >= floor) & (F.coalesce(F.col("p.box_id"), F.lit(-1)) != F.col("box_id")))
    count = rivals.groupBy(*keys).agg(F.count("*").alias("competing"))
    return chosen.join(count, keys, "left").select(*keys, F.col("p.box_id").alias("subject"), F.col("p.score").alias("score"), F.col("p.area_frac").alias("area_frac"), "kept_framing", F.coalesce("competing", F.lit(0)).alias("competing"))
