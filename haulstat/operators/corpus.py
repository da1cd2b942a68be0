"""Photo-corpus jobs: cleaning, attribution, coverage, twins, splits, reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import photos as P
from ..functions.draws import draw_key, hash32
from .ranking import exact_percentiles, first_true, grouped_positions, with_row

VEHICLE = ["source_key", "listing_id"]


def with_quality(photos: DataFrame) -> DataFrame:
    c = F.col
    return photos.withColumn("capture_quality", P.capture_quality(
        c("blur"), c("brightness"), c("dark_frac"), c("bright_frac"), c("contrast"), c("width"), c("height")))


def label_duplicates(photos: DataFrame, order: list[str], label: str = "dup_reason") -> DataFrame:
    """Mark every photo that is not the first of its hash.

    The first is found by a partial minimum per hash, so a placeholder image
    shared by a third of the corpus costs one row per input partition. The
    look-up back is a join that adaptive execution may split on that hash.
    """
    first = photos.groupBy("phash").agg(F.min(F.struct(*order)).alias("_first"))
    mine = F.struct(*order) == F.col("_first")
    same = F.struct(*VEHICLE) == F.struct(*[F.col(f"_first.{c}").alias(c) for c in VEHICLE])
    reason = F.when(mine, None).when(same, "drop_dup_listing").otherwise("drop_dup_corpus")
    return photos.join(first, "phash").withColumn(label, reason).drop("_first")


def clean(photos: DataFrame) -> DataFrame:
    """Every photo with the first reason it drops (NULL: kept) and its quality.

    A hash is claimed before the content gate, so a rejected photo still
    suppresses its copies.
    """
    checked = photos.withColumn("_integrity", P.drop_reason(F.col("width"), F.col("height")))
    sound = label_duplicates(checked.where(F.col("_integrity").isNull()), VEHICLE + ["image_index"], "_dup")
    rejected = F.when(F.col("content_label") != "keep", F.concat(F.lit("drop_content_"), F.col("content_label")))
    sound = sound.withColumn("drop_reason", F.coalesce("_dup", rejected)).drop("_dup", "_integrity")
    failed = (checked.where(F.col("_integrity").isNotNull())
              .withColumnRenamed("_integrity", "drop_reason"))
    return with_quality(sound.unionByName(failed))


def bucket_cuts(kept: DataFrame) -> DataFrame:
    """The 33rd and 67th percentile of capture quality: one row, ``low`` and ``high``."""
    return exact_percentiles(kept, [], "capture_quality", [0.33, 0.67], ["low", "high"])


def with_buckets(photos: DataFrame, cuts: DataFrame) -> DataFrame:
    out = with_row(photos, cuts, "low", "high")
    bucket = P.quality_bucket(F.col("capture_quality"), F.col("low"), F.col("high"))
    return out.withColumn("quality_bucket", bucket).drop("low", "high")


def shared_hashes(downloads: DataFrame) -> DataFrame:
    """Hashes published under more than one vehicle (min differs from max)."""
    key = F.struct(*VEHICLE)
    return (downloads.groupBy("phash").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
            .where("_lo <> _hi").select("phash"))


def attributable(cleaned: DataFrame, downloads: DataFrame) -> DataFrame:
    return cleaned.join(shared_hashes(downloads), "phash", "left_anti")


def coverage_cut(photos: DataFrame) -> DataFrame:
    """Vehicles ranked by photo count inside their source; the top half is kept."""
    counts = photos.groupBy(*VEHICLE).agg(F.count("*").alias("n_photos"))
    ranked = grouped_positions(counts, ["source_key"], [F.col("n_photos").desc(), F.col("listing_id")])
    return ranked.withColumn("kept", F.col("position") <= F.floor((F.col("group_size") + 1) / 2))


def counts_by_facet(df: DataFrame, facets: list[str], vehicle: list[str] | None = None) -> DataFrame:
    """Counts per value of each facet in one scan (grouping sets)."""
    base = df
    measure = [F.sum("_n").alias("n_rows")]
    keys = facets + (vehicle or [])
    base = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    if vehicle:
        measure.append(F.count_distinct(*vehicle).alias("n_vehicles"))
    sets = base.groupingSets([[F.col(f)] for f in facets], *[F.col(f) for f in facets]).agg(
        F.grouping_id().alias("_g"), *measure)
    top = len(facets) - 1
    all_bits = (1 << len(facets)) - 1
    name = first_true([(F.col("_g") == all_bits - (1 << (top - i)), f) for i, f in enumerate(facets)])
    value = first_true([(F.col("_g") == all_bits - (1 << (top - i)), F.col(f).cast("string")) for i, f in enumerate(facets)])
    kept = ["n_rows"] + (["n_vehicles"] if vehicle else [])
    return sets.select(name.alias("facet"), value.alias("value"), *kept)


def hash_split(df: DataFrame, key: list[str], seed: int = 20260912) -> DataFrame:
    """70/15/15 by vehicle from the key alone: stable when vehicles are added."""
    return df.withColumn("split", split_of(draw_text(seed, key)))


def draw_text(seed: int, key: list[str]) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])


def split_of(text: Column) -> Column:
    slot = F.pmod(hash32(text), F.lit(100))
    return F.when(slot < 70, "train").when(slot < 85, "val").otherwise("test")


def exact_split(vehicles: DataFrame, market: str, key: list[str], seed: int = 20260912) -> DataFrame:
    """Exact 70/15/15 shares inside each market, in draw order."""
    drawn = vehicles.withColumn("_draw", draw_key(seed, *key))
    ranked = grouped_positions(drawn, [market], [F.col("_draw"), *[F.col(c) for c in key]])
    train = F.floor(F.col("group_size") * 0.70)
    val = F.floor(F.col("group_size") * 0.15)
    part = F.when(F.col("position") <= train, "train").when(F.col("position") <= train + val, "val").otherwise("test")
    return ranked.withColumn("split", part).drop("_draw")


def twin_pairs(photos: DataFrame, twins: DataFrame) -> DataFrame:
    """Original and degraded copy side by side in one grouping, no self-join."""
    key = ["source_key", "listing_id", "image_index"]
    both = photos.select(*key, "variant", "path", "view", F.lit(None).cast("double").alias("severity"),
                         F.lit(None).cast("string").alias("clean_path"), F.lit(None).cast("string").alias("degradations"))
    both = both.unionByName(twins.select(*key, "variant", "path", "view", "severity", "clean_path", "degradations"))

    def of(variant, column):
        return F.min(F.when(F.col("variant") == variant, F.col(column)))

    return (both.groupBy(*key).agg(
        of("original", "path").alias("original_path"), of("degraded", "path").alias("twin_path"),
        of("original", "view").alias("view"), of("degraded", "severity").alias("severity"),
        of("degraded", "clean_path").alias("_check"), of("degraded", "degradations").alias("degradations"))
        .where("original_path is not null and twin_path is not null")
        .withColumn("path_agrees", F.col("_check") == F.col("original_path")).drop("_check"))


def quality_label(good: Column, poor: Column, total: Column) -> Column:
    return F.when(good / total >= 0.6, "dealer").when(poor / total >= 0.5, "phone").otherwise("mixed")


def vehicle_table(photos: DataFrame) -> DataFrame:
    """One row per vehicle: first values, views, mean quality (in whole ten-thousandths, rounded half up in integers), set label."""
    g = photos.groupBy(*VEHICLE).agg(
        F.min_by("market", "image_index").alias("market"), F.count("*").alias("n_photos"),
        F.array_sort(F.collect_set("view")).alias("_views"), F.sum(F.round(F.col("capture_quality") * 10000).cast("long")).alias("_q"), F.count("capture_quality").alias("_qn"),
        F.count_if(F.col("quality_bucket") == "good").alias("_good"),
        F.count_if(F.col("quality_bucket") == "poor").alias("_poor"))
    return g.select(*VEHICLE, "market", "n_photos", F.size("_views").alias("n_views"),
                    F.array_join("_views", "|").alias("views"), (F.expr("(2 * _q + _qn) div (2 * _qn)") / 10000).alias("mean_quality"),
                    quality_label(F.col("_good"), F.col("_poor"), F.col("n_photos")).alias("set_label"))
