"""Corpus queries: what survives, why the rest drops, splits, twins, reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import ranking as R
from ..sources import files
from .registry import query
from .scalars import QUALITY_SQL

KEPT = "drop_reason IS NULL"

CLEAN_SQL = f"""
i AS (SELECT *, CASE WHEN least(width, height) < 200 OR width * height < 120000 THEN 'drop_too_small'
   WHEN NOT (width * 1.0 / height BETWEEN 0.3 AND 3.5) THEN 'drop_aspect' END AS bad FROM photos),
d AS (SELECT *, row_number() OVER w AS rn, first_value(source_key || '/' || listing_id) OVER w AS owner
   FROM i WHERE bad IS NULL WINDOW w AS (PARTITION BY phash ORDER BY source_key, listing_id, image_index)),
cleaned AS (
 SELECT path, phash, source_key, listing_id, image_index, view, market, content_label, blur, brightness, contrast, dark_frac, bright_frac, width, height,
  CASE WHEN rn > 1 THEN CASE WHEN owner = source_key || '/' || listing_id THEN 'drop_dup_listing' ELSE 'drop_dup_corpus' END
   WHEN content_label <> 'keep' THEN 'drop_content_' || content_label END AS drop_reason FROM d
 UNION ALL SELECT path, phash, source_key, listing_id, image_index, view, market, content_label, blur, brightness, contrast, dark_frac, bright_frac, width, height, bad FROM i WHERE bad IS NOT NULL),
scored AS (SELECT *, round({QUALITY_SQL}, 4) AS capture_quality FROM cleaned),
cuts AS (SELECT quantile_cont(capture_quality, 0.33) AS low, quantile_cont(capture_quality, 0.67) AS high FROM scored WHERE drop_reason IS NULL),
kept AS (SELECT s.*, CASE WHEN capture_quality <= low THEN 'poor' WHEN capture_quality <= high THEN 'fair' ELSE 'good' END AS quality_bucket
   FROM scored s, cuts WHERE drop_reason IS NULL)"""


def cleaned_and_kept(t):
    cleaned = K.clean(t.photos)
    kept = cleaned.where(KEPT)
    return cleaned, K.with_buckets(kept, K.bucket_cuts(kept))


@query("a01_multi_source_union", "photos twins", """
SELECT variant, source_key, count(*) AS n, count(clean_path) AS n_twins FROM (
 SELECT variant, source_key, NULL AS clean_path FROM photos UNION ALL SELECT variant, source_key, clean_path FROM twins) GROUP BY 1, 2""")
def multi_source(t):
    both = files.union_sources({"photos": t.photos, "twins": t.twins, "absent": None}, tag="feed")
    return both.groupBy("variant", "source_key").agg(F.count("*").alias("n"), F.count("clean_path").alias("n_twins"))


@query("c01_first_of_hash", "photos", """
SELECT path, CASE WHEN rn > 1 THEN CASE WHEN owner = source_key || '/' || listing_id THEN 'drop_dup_listing' ELSE 'drop_dup_corpus' END END AS dup_reason
FROM (SELECT *, row_number() OVER w AS rn, first_value(source_key || '/' || listing_id) OVER w AS owner FROM photos
 WINDOW w AS (PARTITION BY phash ORDER BY source_key, listing_id, image_index))""")
def first_of_hash(t):
    return K.label_duplicates(t.photos, K.VEHICLE + ["image_index"]).select("path", "dup_reason")


@query("c02_attribution_filter", "photos", CLEAN_SQL + """,
shared AS (SELECT phash FROM photos GROUP BY phash HAVING count(DISTINCT source_key || '/' || listing_id) > 1)
SELECT path, phash FROM kept WHERE phash NOT IN (SELECT phash FROM shared)""")
def attribution(t):
    return K.attributable(K.clean(t.photos).where(KEPT), t.photos).select("path", "phash")


@query("c03_coverage_cut", "photos", """
c AS (SELECT source_key, listing_id, count(*) AS n_photos FROM photos GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY n_photos DESC, listing_id) AS position, count(*) OVER (PARTITION BY source_key) AS size FROM c)
SELECT source_key, listing_id, n_photos, position, position <= (size + 1) // 2 AS kept,
 min(CASE WHEN position <= (size + 1) // 2 THEN n_photos END) OVER (PARTITION BY source_key) AS cut_off FROM r""")
def coverage_cut(t):
    ranked = K.coverage_cut(t.photos)
    cut = ranked.groupBy("source_key").agg(F.min(F.when(F.col("kept"), F.col("n_photos"))).alias("cut_off"))
    return ranked.join(cut, "source_key").select("source_key", "listing_id", "n_photos", "position", "kept", "cut_off")


@query("c04_twins_follow_originals", "photos twins", CLEAN_SQL + """,
ex AS (SELECT doc_id FROM labels WHERE toxic = 1),
gone AS (SELECT path FROM photos JOIN ex USING (doc_id)),
alive AS (SELECT path FROM kept WHERE path NOT IN (SELECT path FROM gone))
SELECT path, clean_path, clean_path IN (SELECT path FROM alive) AS survives,
 CASE WHEN clean_path IN (SELECT path FROM alive) THEN 'kept' ELSE 'orphan' END AS list_name FROM twins""")
def twins_follow(t):
    excluded = t.labels.where("toxic = 1").select("doc_id")
    alive = K.clean(t.photos).where(KEPT).join(excluded, "doc_id", "left_anti").select(F.col("path").alias("clean_path"))
    kept = t.twins.join(alive, "clean_path", "left_semi").select("path", "clean_path", F.lit(True).alias("survives"), F.lit("kept").alias("list_name"))
    orphans = t.twins.join(alive, "clean_path", "left_anti").select("path", "clean_path", F.lit(False).alias("survives"), F.lit("orphan").alias("list_name"))
    return kept.unionByName(orphans)


@query("c06_eligibility_counts", "listings", """
SELECT market, count(*) AS n, count_if(price IS NULL OR price <= 0) AS no_price, count_if(km IS NULL) AS no_distance, count_if(n_images < 8) AS few_photos,
 count_if(price > 0 AND km IS NOT NULL AND n_images >= 8 AND model <> 'PROMO') AS eligible FROM listings GROUP BY 1""")
def eligibility(t):
    ok = (F.col("price") > 0) & F.col("km").isNotNull() & (F.col("n_images") >= 8) & (F.col("model") != "PROMO")
    return t.listings.groupBy("market").agg(
        F.count("*").alias("n"), F.count_if(F.col("price").isNull() | (F.col("price") <= 0)).alias("no_price"),
        F.count_if(F.col("km").isNull()).alias("no_distance"), F.count_if(F.col("n_images") < 8).alias("few_photos"),
        F.count_if(ok).alias("eligible"))


@query("c14_hash_split", "listings", """
SELECT market, split, count(*) AS n FROM (SELECT market, CASE WHEN s < 70 THEN 'train' WHEN s < 85 THEN 'val' ELSE 'test' END AS split
 FROM (SELECT market, ('0x' || substr(md5('20260912|' || source_key || '|' || listing_id), 1, 8))::BIGINT % 100 AS s FROM listings)) GROUP BY 1, 2""")
def hash_split(t):
    return K.hash_split(t.listings, K.VEHICLE).groupBy("market", "split").agg(F.count("*").alias("n"))


@query("c14_exact_split", "listings", """
r AS (SELECT market, source_key, listing_id, row_number() OVER (PARTITION BY market ORDER BY md5('20260912|' || source_key || '|' || listing_id), source_key, listing_id) AS seat,
  count(*) OVER (PARTITION BY market) AS n FROM listings)
SELECT source_key, listing_id, CASE WHEN seat <= floor(n * 0.70) THEN 'train' WHEN seat <= floor(n * 0.70) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM r""")
def exact_split(t):
    return K.exact_split(t.listings.select("market", *K.VEHICLE), "market", K.VEHICLE).select(*K.VEHICLE, "split")


@query("d01_photo_listing_enrichment", "photos", """
l AS (SELECT n_name AS source_key, CAST(n_nationkey AS VARCHAR) AS lid, n_regionkey FROM nation)
SELECT p.path, l.n_regionkey AS region, l.lid IS NULL AS no_listing FROM photos p LEFT JOIN l ON p.listing_id = l.lid""")
def enrichment(t):
    owners = t.nation.select(F.col("n_nationkey").cast("string").alias("listing_id"), F.col("n_regionkey").alias("region"))
    joined = t.photos.select("path", "listing_id").join(owners, "listing_id", "left")
    return joined.select("path", "region", F.col("region").isNull().alias("no_listing"))


@query("d02_kept_counts_on_vehicles", "photos", CLEAN_SQL + """,
v AS (SELECT source_key, listing_id, count(*) AS n_images FROM photos GROUP BY 1, 2),
k AS (SELECT source_key, listing_id, count(*) AS n_images_kept FROM kept GROUP BY 1, 2)
SELECT v.source_key, v.listing_id, n_images, n_images_kept FROM v JOIN k USING (source_key, listing_id)""")
def kept_counts(t):
    cleaned = K.clean(t.photos)
    counted = cleaned.groupBy(*K.VEHICLE).agg(F.count("*").alias("n_images"),
                                              F.count_if(F.col("drop_reason").isNull()).alias("n_images_kept"))
    return counted.where("n_images_kept > 0")


@query("d03_twin_pairs", "photos twins", """
SELECT p.source_key, p.listing_id, p.image_index, p.path AS original_path, x.path AS twin_path, p.view, round(x.severity, 4) AS severity, x.degradations, x.clean_path = p.path AS path_agrees
FROM photos p JOIN twins x ON x.source_key = p.source_key AND x.listing_id = p.listing_id AND x.image_index = p.image_index""")
def twin_pairs(t):
    return K.twin_pairs(t.photos, t.twins).withColumn("severity", F.round("severity", 4))


@query("e02_quality_cuts", "photos", CLEAN_SQL + " SELECT round(low, 4) AS low, round(high, 4) AS high, (SELECT count(*) FROM kept) AS n FROM cuts")
def quality_cuts(t):
    return K.bucket_cuts(K.clean(t.photos).where(KEPT)).select(
        F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query("b14_quality_bucket", "photos", CLEAN_SQL + """
SELECT path, quality_bucket, CASE WHEN capture_quality <= 0.70 THEN 'poor' WHEN capture_quality > 0.88 THEN 'good' ELSE 'fair' END AS online_bucket FROM kept""")
def buckets(t):
    from ..functions.photos import ONLINE_CUTS, quality_bucket
    _, kept = cleaned_and_kept(t)
    return kept.select("path", "quality_bucket", quality_bucket(F.col("capture_quality"), *ONLINE_CUTS).alias("online_bucket"))


@query("e03_capture_floors", "photos twins", """
q AS (SELECT quantile_cont(blur, 0.04) AS blur_floor, quantile_cont(blur, 0.15) AS blur_warn, quantile_cont(brightness, 0.04) AS dark_floor,
  quantile_cont(brightness, 0.96) AS bright_ceiling, quantile_cont(contrast, 0.04) AS contrast_floor FROM twins),
f AS (SELECT 'degraded' AS variant, source_key, listing_id, blur < blur_floor OR brightness < dark_floor OR brightness > bright_ceiling OR contrast < contrast_floor AS bad FROM twins, q
 UNION ALL SELECT 'original', source_key, listing_id, blur < blur_floor OR brightness < dark_floor OR brightness > bright_ceiling OR contrast < contrast_floor FROM photos, q),
v AS (SELECT variant, source_key, listing_id, count(*) AS n, count_if(bad) AS nb FROM f GROUP BY ALL)
SELECT variant, round(any_value(blur_floor), 4) AS blur_floor, round(any_value(blur_warn), 4) AS blur_warn, round(any_value(contrast_floor), 4) AS contrast_floor,
 sum(n) AS photos, round(sum(nb) * 1.0 / sum(n), 4) AS reject_rate, count(*) AS vehicles, count_if(nb = n) AS vehicles_rejected FROM v, q GROUP BY 1""")
def capture_floors(t):
    def pct(column, probs, names):
        return R.exact_percentiles(t.twins, [], column, probs, names)

    both = t.twins.select(*K.VEHICLE, "variant", "blur", "brightness", "contrast").unionByName(
        t.photos.select(*K.VEHICLE, "variant", "blur", "brightness", "contrast"))
    both = R.with_row(both, pct("blur", [0.04, 0.15], ["blur_floor", "blur_warn"]), "blur_floor", "blur_warn")
    both = R.with_row(both, pct("brightness", [0.04, 0.96], ["dark_floor", "bright_ceiling"]), "dark_floor", "bright_ceiling")
    both = R.with_row(both, pct("contrast", [0.04], ["contrast_floor"]), "contrast_floor")
    bad = ((F.col("blur") < F.col("blur_floor")) | (F.col("brightness") < F.col("dark_floor"))
           | (F.col("brightness") > F.col("bright_ceiling")) | (F.col("contrast") < F.col("contrast_floor")))
    cuts = ["blur_floor", "blur_warn", "contrast_floor"]
    per_vehicle = both.groupBy("variant", *K.VEHICLE).agg(
        F.count("*").alias("n"), F.count_if(bad).alias("nb"), *[F.max(c).alias(c) for c in cuts])
    return per_vehicle.groupBy("variant").agg(
        *[F.round(F.max(c), 4).alias(c) for c in cuts], F.sum("n").alias("photos"),
        F.round(F.sum("nb") / F.sum("n"), 4).alias("reject_rate"), F.count("*").alias("vehicles"),
        F.count_if(F.col("nb") == F.col("n")).alias("vehicles_rejected"))


@query("e05_cleaning_report", "photos", CLEAN_SQL + """,
a AS (SELECT c.drop_reason, c.content_label, c.view, c.source_key, k.quality_bucket FROM cleaned c LEFT JOIN kept k ON k.path = c.path)
SELECT 'drop_reason' AS facet, drop_reason AS value, count(*) AS n_rows FROM a GROUP BY 2
UNION ALL SELECT 'content_label', content_label, count(*) FROM a GROUP BY 2
UNION ALL SELECT 'view', view, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'source_key', source_key, count(*) FROM a GROUP BY 2
UNION ALL SELECT 'quality_bucket', quality_bucket, count(*) FROM a GROUP BY 2""")
def cleaning_report(t):
    cleaned = K.clean(t.photos)
    bucketed = K.with_buckets(cleaned, K.bucket_cuts(cleaned.where(KEPT)))
    bucketed = bucketed.withColumn("quality_bucket", F.when(F.col("drop_reason").isNull(), F.col("quality_bucket")))
    return K.counts_by_facet(bucketed, ["drop_reason", "content_label", "quality_bucket", "view", "source_key"])


@query("e06_dataset_summary", "photos", CLEAN_SQL + """,
a AS (SELECT *, CASE WHEN s < 70 THEN 'train' WHEN s < 85 THEN 'val' ELSE 'test' END AS split, source_key || '/' || listing_id AS v
 FROM (SELECT *, ('0x' || substr(md5('20260912|' || source_key || '|' || listing_id), 1, 8))::BIGINT % 100 AS s FROM kept))
SELECT 'market' AS facet, market AS value, count(*) AS n_rows, count(DISTINCT v) AS n_vehicles FROM a GROUP BY 2
UNION ALL SELECT 'source_key', source_key, count(*), count(DISTINCT v) FROM a GROUP BY 2 UNION ALL SELECT 'split', split, count(*), count(DISTINCT v) FROM a GROUP BY 2
UNION ALL SELECT 'view', view, count(*), count(DISTINCT v) FROM a GROUP BY 2 UNION ALL SELECT 'quality_bucket', quality_bucket, count(*), count(DISTINCT v) FROM a GROUP BY 2""")
def dataset_summary(t):
    _, kept = cleaned_and_kept(t)
    split = K.hash_split(kept, K.VEHICLE).withColumn("vehicle", F.concat_ws("/", *K.VEHICLE))
    return K.counts_by_facet(split, ["market", "source_key", "split", "view", "quality_bucket"], ["vehicle"])


@query("e07_card_statistics", "photos", CLEAN_SQL + """,
c AS (SELECT source_key, listing_id, count(*) AS n FROM kept GROUP BY 1, 2),
o AS (SELECT n, row_number() OVER (ORDER BY n) AS seat, count(*) OVER () AS m FROM c)
SELECT (SELECT min(n) FROM c) AS photos_min, (SELECT max(n) FROM c) AS photos_max, (SELECT n FROM o WHERE seat = m // 2 + 1) AS photos_median,
 (SELECT count(*) FROM c) AS vehicles, (SELECT count(DISTINCT source_key || '/' || listing_id) FROM photos) - (SELECT count(*) FROM c) AS vehicles_lost""")
def card_statistics(t):
    cleaned = K.clean(t.photos)
    per = cleaned.groupBy(*K.VEHICLE).agg(F.count_if(F.col("drop_reason").isNull()).alias("n"))
    # Counts per count: the histogram stays small however many vehicles there are.
    hist = per.groupBy("n").agg(F.count("*").alias("vehicles"))
    alive = hist.where("n > 0")
    upto = R.running_total(alive.withColumn("_all", F.lit(0)), ["_all"], [F.col("n")], "vehicles", "upto").drop("_all")
    totals = alive.agg(F.sum("vehicles").alias("m"))
    lost = hist.where("n = 0").agg(F.coalesce(F.sum("vehicles"), F.lit(0)).alias("vehicles_lost"))
    middle = F.floor(F.col("m") / 2) + 1
    placed = R.with_row(upto, totals, "m")
    stats = placed.agg(F.min("n").alias("photos_min"), F.max("n").alias("photos_max"),
                       F.min(F.when(F.col("upto") >= middle, F.col("n"))).alias("photos_median"),
                       F.max("m").alias("vehicles"))
    return R.with_row(stats, lost, "vehicles_lost")


@query("e08_vehicle_table", "photos", CLEAN_SQL + """
SELECT source_key, listing_id, arg_min(market, image_index) AS market, count(*) AS n_photos, count(DISTINCT view) AS n_views,
 list_aggregate(list_sort(list(DISTINCT view)), 'string_agg', '|') AS views, (2 * sum(CAST(round(capture_quality * 10000) AS BIGINT))::BIGINT + count(capture_quality)) // (2 * count(capture_quality)) / 10000 AS mean_quality,
 CASE WHEN count_if(quality_bucket = 'good') / count(*) >= 0.6 THEN 'dealer' WHEN count_if(quality_bucket = 'poor') / count(*) >= 0.5 THEN 'phone' ELSE 'mixed' END AS set_label
FROM kept GROUP BY 1, 2""")
def vehicle_table(t):
    _, kept = cleaned_and_kept(t)
    return K.vehicle_table(kept)


@query("h04_cover_pick", "photos", """
SELECT source_key, listing_id, arg_max(path, (CASE WHEN view IN ('exterior_front_34','exterior_side','exterior_front','exterior_rear') THEN 1 ELSE 0 END, q, -image_index)) AS cover
FROM (SELECT *, round(""" + QUALITY_SQL + """, 4) AS q FROM photos) GROUP BY 1, 2""")
def cover_pick(t):
    from ..functions.photos import WHOLE_VIEWS
    best = F.struct(F.col("view").isin(*WHOLE_VIEWS).cast("int").alias("w"), "capture_quality", (-F.col("image_index")).alias("i"))
    return K.with_quality(t.photos).groupBy(*K.VEHICLE).agg(F.max_by("path", best).alias("cover"))


@query("l02_gallery_order", "listings", """
SELECT listing_id, make, year FROM listings WHERE dealer_name NOT IN (SELECT s_name FROM supplier WHERE s_acctbal < 0)
UNION ALL SELECT 'demo-' || CAST(s_suppkey AS VARCHAR), s_name, 2020 FROM supplier WHERE s_acctbal < 0 ORDER BY make, year DESC""")
def gallery_order(t):
    rehearsed = t.supplier.where("s_acctbal < 0")
    corpus = t.listings.join(rehearsed.select(F.col("s_name").alias("dealer_name")), "dealer_name", "left_anti")
    demo = rehearsed.select(F.concat(F.lit("demo-"), F.col("s_suppkey").cast("string")).alias("listing_id"),
                            F.col("s_name").alias("make"), F.lit(2020).alias("year"))
    return corpus.select("listing_id", "make", "year").unionByName(demo).orderBy("make", F.desc("year"))


@query("l04_downloads_by_photo_count", "listings", """
SELECT listing_id, n_images FROM listings ORDER BY n_images DESC, listing_id LIMIT 200""")
def downloads(t):
    return t.listings.select("listing_id", "n_images").orderBy(F.desc("n_images"), "listing_id").limit(200)


@query("l05_union_of_variants", "photos twins", """
SELECT variant, count(*) AS n, count(severity) AS with_severity FROM (SELECT variant, NULL AS severity FROM photos UNION ALL SELECT variant, severity FROM twins) GROUP BY 1""")
def variants(t):
    both = t.photos.unionByName(t.twins, allowMissingColumns=True)
    return both.groupBy("variant").agg(F.count("*").alias("n"), F.count("severity").alias("with_severity"))
