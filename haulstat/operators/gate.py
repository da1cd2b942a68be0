"""Set-level gate: what a vehicle's photos cover, and what the set is good for."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import photos as P
from .ranking import running_total

# Views that show a part, views a set must have.
PART_VIEWS = ["tire_wheel", "interior_cab", "dashboard_odometer", "engine_bay", "chassis_undercarriage", "fifth_wheel"]
REQUIRED_VIEWS = ["exterior_front_34", "tire_wheel", "dashboard_odometer"]
MIN_USABLE = 3


def body_tag(photos: DataFrame, unit: list[str]) -> DataFrame:
    """Most frequent body tag of usable whole-vehicle frames and its upper-median confidence.

    Equal confidences are counted first; the median is read from their running
    counts, as given and not rounded.
    """
    rows = photos.where(F.col("usable") & F.col("view").isin(*P.WHOLE_VIEWS) & (F.coalesce("body_tag", F.lit("unknown")) != "unknown"))
    bins = rows.groupBy(*unit, "body_tag", F.col("body_tag_conf").alias("c")).agg(F.count("*").alias("k"), F.min("photo_seq").alias("seq"))
    tags = bins.groupBy(*unit, "body_tag").agg(F.sum("k").alias("n"), F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("c", "k"))).alias("h"))
    upto = F.aggregate("h", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("c")),
                       lambda a, x: F.struct((a["n"] + x["k"]).alias("n"), F.when(a["c"].isNull() & (a["n"] + x["k"] > F.floor(F.col("n") / 2)), x["c"]).otherwise(a["c"]).alias("c")))
    tags = tags.withColumn("conf", upto["c"])
    best = tags.groupBy(*unit).agg(F.max(F.struct("n", (-F.col("seq")).alias("s"), "body_tag", "conf")).alias("b"))
    return best.select(*unit, F.col("b.body_tag").alias("body_tag"), F.round("b.conf", 3).alias("body_tag_conf"))


def decide(photos: DataFrame, unit: list[str]) -> DataFrame:
    """Decision ladder per unit from one grouping: flags ``usable``, ``truck``, ``other_subject``, ``view``, ``content_label``."""
    whole = F.col("view").isin(*P.WHOLE_VIEWS)
    part = F.col("view").isin(*PART_VIEWS) & (F.col("view_conf") >= 0.5) & (F.col("content_label") == "keep")
    g = photos.groupBy(*unit).agg(
        F.count("*").alias("photos"), F.count_if("usable").alias("usable"), F.count_if("truck").alias("trucks"), F.count_if("other_subject").alias("others"),
        F.count_if(F.col("usable") & part).alias("parts"), F.count_if(F.col("usable") & whole).alias("wholes"),
        F.array_sort(F.collect_set(F.when(F.col("usable"), F.col("view")))).alias("views"))  # at most eleven views
    missing = F.array_except(F.array(*[F.lit(v) for v in REQUIRED_VIEWS]), "views")
    g = g.withColumn("missing", missing)
    half = F.greatest(F.lit(1), F.floor((F.col("usable") + 1) / 2))
    decision = (F.when(F.col("usable") == 0, "refuse_quality").when((F.col("trucks") == 0) & ((F.col("others") > 0) | (F.col("parts") < half)), "refuse_not_a_truck")
                .when((F.col("trucks") == 0) | (F.col("wholes") == 0), "ask_more_whole_vehicle").when(F.col("usable") < MIN_USABLE, "ask_more_photos")
                .when(F.size("missing") > 0, "ask_more_views").otherwise("pass"))
    return g.withColumn("decision", decision).withColumn("blocks_pricing", decision.isin("refuse_quality", "refuse_not_a_truck", "ask_more_whole_vehicle"))


def pricing_blocker(clusters: Column, min_clusters: int, tag: Column, tag_conf: Column, rigid_conf: float, body: Column, body_conf: Column, same: Column) -> Column:
    """First reason a price would be dishonest, else NULL."""
    named = F.coalesce(F.trim(body), F.lit("")) != ""
    return (F.when(clusters >= min_clusters, "several_vehicles").when(~named & (tag == "rigid") & (tag_conf >= rigid_conf), "rigid_tag")
            .when(~same, "not_one_vehicle").when(named & ~F.lower(body).isin("tractor_unit", "unknown") & (body_conf >= 0.55), "body_type"))


def cluster_threshold(counts: DataFrame, column: str, budget: float) -> DataFrame:
    """Histogram of a count with P(count >= k), and the smallest k >= 2 within the budget."""
    hist = counts.groupBy(column).agg(F.count("*").alias("n")).withColumn("_all", F.lit(0))
    tail = running_total(hist, ["_all"], [F.col(column).desc()], "n", "at_least").drop("_all")
    total = counts.agg(F.count("*").alias("total"))
    from .ranking import with_row
    shares = with_row(tail, total, "total").withColumn("tail_share", F.col("at_least") / F.col("total"))
    # The smallest k is one above the largest count whose tail is still too heavy.
    heavy = shares.agg(F.max(F.when(F.col("tail_share") > budget, F.col(column))).alias("heavy"))
    out = with_row(shares, heavy, "heavy")
    return out.withColumn("threshold", F.greatest(F.lit(2), F.coalesce("heavy", F.lit(1)) + 1)).drop("heavy", "total")


def view_changes(views: Column, missing: Column, confident: Column) -> dict[str, Column]:
    """Views a trained head restores to a set, and what is left to ask for."""
    restored = F.array_intersect(missing, confident)
    return {"restored": restored, "still_missing": F.array_except(missing, restored), "views_after": F.array_sort(F.array_union(views, restored))}
