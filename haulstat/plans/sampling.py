"""Sampling, banding and fold queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_key, fold_of, uniform
from ..operators import corpus as K
from ..operators import ranking as R
from ..operators import sampling as S
from .registry import query
from .scalars import QUALITY_SQL

LID = ["listing_id"]
PRIO = "list_position(['exterior_front_34','tire_wheel','dashboard_odometer','exterior_side','interior_cab','chassis_undercarriage','fifth_wheel','engine_bay','damage_detail','exterior_front','exterior_rear'], view)"
IDPRIO = "list_position(['exterior_front_34','exterior_side','exterior_front','exterior_rear','tire_wheel','dashboard_odometer','interior_cab','chassis_undercarriage','fifth_wheel','engine_bay','damage_detail'], view)"


@query("c07_view_round_robin", "photos", f"""
a AS (SELECT *, row_number() OVER (PARTITION BY source_key, listing_id, view ORDER BY round({QUALITY_SQL}, 4) DESC, image_index) AS turn FROM photos),
b AS (SELECT *, row_number() OVER (PARTITION BY source_key, listing_id ORDER BY turn, {PRIO}, view) AS slot FROM a)
SELECT source_key, listing_id, path, slot FROM b WHERE slot <= 8""")
def view_round_robin(t):
    df = K.with_quality(t.photos)
    best = [F.col("capture_quality").desc(), F.col("image_index")]
    return S.round_robin(df, K.VEHICLE, "view", S.priority_of(F.col("view"), S.VIEW_PRIORITY), best, 8).select(*K.VEHICLE, "path", "slot")


@query("c07_identity_round_robin", "photos", f"""
f AS (SELECT *, bool_or(view IN ('exterior_front_34','exterior_side','exterior_front','exterior_rear')) OVER (PARTITION BY source_key, listing_id) AS whole FROM photos),
a AS (SELECT *, row_number() OVER (PARTITION BY source_key, listing_id, view ORDER BY round({QUALITY_SQL}, 4) DESC, image_index) AS turn FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY source_key, listing_id ORDER BY turn, CASE WHEN whole THEN {IDPRIO} ELSE {PRIO} END, view) AS slot FROM a)
SELECT source_key, listing_id, path, slot FROM b WHERE slot <= 4""")
def identity_round_robin(t):
    df = K.with_quality(t.photos)
    return S.identity_round_robin(df, K.VEHICLE, [F.col("capture_quality").desc(), F.col("image_index")], 4).select(*K.VEHICLE, "path", "slot")


ALLOC_SQL = """
s AS (SELECT market, make, count(*) AS n FROM listings GROUP BY 1, 2),
e AS (SELECT *, least(2000, sum(n) OVER ()) AS want, sum(n) OVER () AS pool FROM s),
f AS (SELECT *, floor(want * n / pool) AS fl, round(want * n / pool - floor(want * n / pool), 9) AS rest FROM e),
g AS (SELECT *, row_number() OVER (ORDER BY rest DESC, market, make) AS seat, sum(fl) OVER () AS given FROM f),
q AS (SELECT market, make, n, CAST(fl + CASE WHEN seat <= want - given THEN 1 ELSE 0 END AS BIGINT) AS quota FROM g)"""


def quotas(t):
    strata = t.listings.groupBy("market", "make").agg(F.count("*").alias("n"))
    return S.allocate(strata, 2000, "n")


@query("c08_largest_remainder_quota", "listings", ALLOC_SQL + " SELECT market, make, n, quota FROM q")
def remainder_quota(t):
    return quotas(t)


@query("c08_stratified_sample", "listings", ALLOC_SQL + """,
r AS (SELECT market, make, listing_id, row_number() OVER (PARTITION BY market, make ORDER BY md5('7|' || listing_id), listing_id) AS seat FROM listings)
SELECT r.listing_id, r.market, r.make FROM r JOIN q USING (market, make) WHERE seat <= quota""")
def stratified_sample(t):
    pool = t.listings.select("market", "make", "listing_id")
    return S.draw_quota(pool, ["market", "make"], quotas(t), LID, 7).select("listing_id", "market", "make")


@query("c09_share_of_frames", "photos", """
r AS (SELECT *, row_number() OVER (PARTITION BY source_key, listing_id, variant ORDER BY md5('7|' || path), path) AS seat, count(*) OVER (PARTITION BY source_key, listing_id, variant) AS n FROM photos)
SELECT path FROM r WHERE seat <= greatest(1, round_even(n * 0.3, 0))""")
def frame_share(t):
    df = t.photos.select(*K.VEHICLE, "variant", "path")
    return S.keep_share(df, K.VEHICLE + ["variant"], ["path"], 0.3, 7).select("path")


@query("c10_quota_with_dealer_cap", "listings", """
d AS (SELECT year, dealer_name, listing_id, n_images, md5('7|' || listing_id) AS draw FROM listings),
q AS (SELECT year, greatest(1, floor(400 * count(*) / (SELECT count(*) FROM d))) AS quota FROM d GROUP BY 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dealer_name ORDER BY draw, listing_id) AS seat FROM d) WHERE seat <= 12),
p AS (SELECT c.*, row_number() OVER (PARTITION BY c.year ORDER BY draw, listing_id) <= quota AS by_quota FROM c JOIN q USING (year)),
f AS (SELECT *, row_number() OVER (ORDER BY by_quota DESC, n_images DESC, listing_id) AS rk FROM p)
SELECT listing_id, year, dealer_name, by_quota FROM f WHERE by_quota OR rk <= 400""")
def dealer_cap(t):
    df = t.listings.select("year", "dealer_name", "listing_id", "n_images")
    return S.quota_with_cap(df, "year", "dealer_name", LID, 400, 12, [F.col("n_images").desc()], 7).select(
        "listing_id", "year", "dealer_name", "by_quota")


@query("c11_stratified_spread", "listings", """
a AS (SELECT *, md5('7|' || listing_id) AS draw, md5('7|' || make) AS b FROM listings),
r AS (SELECT *, row_number() OVER (PARTITION BY make, year ORDER BY draw, listing_id) AS rd FROM a),
s AS (SELECT *, row_number() OVER (PARTITION BY make ORDER BY rd, draw, listing_id) AS turn FROM r)
SELECT listing_id, make, year FROM s ORDER BY turn, b, make LIMIT 60""")
def stratified_spread(t):
    df = t.listings.select("listing_id", "make", "year")
    return S.spread(df, "make", "year", LID, 60, 7)


@query("c12_rule_based_picks", "listings", """
tr AS (SELECT * FROM listings WHERE market = 'TR' AND km IS NOT NULL),
lo AS (SELECT * FROM tr ORDER BY km, listing_id LIMIT 1), hi AS (SELECT * FROM tr ORDER BY km DESC, listing_id DESC LIMIT 1)
SELECT 'lowest' AS rule, listing_id, km, year, make FROM lo
UNION ALL SELECT * FROM (SELECT 'low_other_year', listing_id, km, year, make FROM tr WHERE year <> (SELECT year FROM lo) ORDER BY km, listing_id LIMIT 1)
UNION ALL SELECT 'highest', listing_id, km, year, make FROM hi
UNION ALL SELECT * FROM (SELECT 'high_other_make', listing_id, km, year, make FROM tr WHERE make <> (SELECT make FROM hi) ORDER BY km DESC, listing_id DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'oldest', listing_id, km, year, make FROM tr ORDER BY year, km DESC, listing_id LIMIT 1)""")
def rule_picks(t):
    tr = t.listings.where("market = 'TR' and km is not null").select("listing_id", "km", "year", "make")
    row = F.struct("listing_id", "km", "year", "make")
    up, down = F.struct("km", "listing_id"), F.struct("km", "listing_id")

    def pick(df, rule, chosen):
        return df.agg(chosen.alias("r")).where("r is not null").select(F.lit(rule).alias("rule"), "r.*")

    lo = tr.agg(F.min_by("year", up).alias("lo_year"))
    hi = tr.agg(F.max_by("make", down).alias("hi_make"))
    other_year = R.with_row(tr, lo, "lo_year").where("year <> lo_year")
    other_make = R.with_row(tr, hi, "hi_make").where("make <> hi_make")
    aged = F.struct("year", (-F.col("km")).alias("k"), "listing_id")
    parts = [pick(tr, "lowest", F.min_by(row, up)), pick(other_year, "low_other_year", F.min_by(row, up)),
             pick(tr, "highest", F.max_by(row, down)), pick(other_make, "high_other_make", F.max_by(row, down)),
             pick(tr, "oldest", F.min_by(row, aged))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("c13_twin_sample", "photos twins", """
b AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY severity, path) AS rk, count(*) OVER (PARTITION BY market) AS n FROM twins),
c AS (SELECT *, greatest(1, (3 * (rk - 1) + n - 2) // (n - 1)) AS band FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY source_key, listing_id, view ORDER BY (band + ('0x' || substr(md5('8|' || source_key || '|' || listing_id), 1, 8))::BIGINT) % 3, image_index) AS turn FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY source_key, listing_id ORDER BY turn, coalesce(list_position(['tire_wheel','chassis_undercarriage','dashboard_odometer'], view), 4), view) AS slot FROM d)
SELECT path, view, CAST(band AS BIGINT) AS band, slot FROM e WHERE slot <= 4""")
def twin_sample(t):
    bands = rank_bands(t.twins, ["market"], [F.col("severity"), F.col("path")], 3)
    # Each vehicle starts at its own band, so the bands fill evenly over all vehicles.
    start = F.conv(F.substring(draw_key(8, *K.VEHICLE), 1, 8), 16, 10).cast("bigint")
    best = [F.pmod(F.col("band") + start, F.lit(3)), F.col("image_index")]
    forced = S.priority_of(F.col("view"), ["tire_wheel", "chassis_undercarriage", "dashboard_odometer"])
    return S.round_robin(bands, K.VEHICLE, "view", forced, best, 4).select("path", "view", "band", "slot")


def rank_bands(df, by, order, q, band="band"):
    """Equal-count bands from ranks: ties and repeated values cannot break them."""
    ranked = R.grouped_positions(df, by, order, "_rk", "_n")
    edge = F.expr(f"greatest(1, ({q} * (_rk - 1) + _n - 2) div greatest(_n - 1, 1))")
    return ranked.withColumn(band, F.when(F.col("_n") >= q, edge)).drop("_rk", "_n")


@query("c15_group_folds", "listings", """
SELECT fold, side, count(*) AS n, count(DISTINCT g) AS n_groups FROM (
 SELECT g, ('0x' || substr(md5(g), 1, 8))::BIGINT % 5 AS fold, CASE WHEN ('0x' || substr(md5('split3|' || g), 1, 8))::BIGINT % 100 < 25 THEN 'test' ELSE 'train' END AS side
 FROM (SELECT market || '|' || make || '|' || model || '|' || CAST(size_class AS VARCHAR) AS g FROM listings)) GROUP BY 1, 2""")
def group_folds(t):
    g = F.concat_ws("|", "market", "make", "model", F.col("size_class").cast("string"))
    per_group = t.listings.groupBy(g.alias("g")).agg(F.count("*").alias("n"))
    side = F.when(fold_of(F.concat(F.lit("split3|"), F.col("g")), 100) < 25, "test").otherwise("train")
    return per_group.groupBy(fold_of(F.col("g"), 5).cast("bigint").alias("fold"), side.alias("side")).agg(
        F.sum("n").alias("n"), F.count("*").alias("n_groups"))


@query("c16_corruption_plan", "photos", """
n(name, w) AS (VALUES ('motion_blur',1.0),('defocus',0.7),('underexposed',1.0),('overexposed',0.6),('low_light_noise',0.9),('sensor_noise',0.6),('jpeg_crush',1.0),
 ('downscaled',0.8),('awkward_angle',1.0),('sun_glare',0.5),('harsh_shadow',0.5),('mud_spatter',0.8),('rain',0.3),('colour_cast',0.7)),
u AS (SELECT path, (('0x' || substr(md5('9#k|' || path), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE AS uk, (('0x' || substr(md5('9#s|' || path), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE AS us FROM photos),
r AS (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY -ln((('0x' || substr(md5('9#' || name || '|' || path), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE) / w::DOUBLE, name) AS seat FROM photos, n),
p AS (SELECT r.path, list_sort(list(name)) AS l FROM r JOIN u USING (path) WHERE seat <= CASE WHEN uk <= 0.4 THEN 2 WHEN uk <= 0.8 THEN 3 ELSE 4 END GROUP BY 1)
SELECT u.path, array_to_string(CASE WHEN list_contains(l, 'underexposed') AND list_contains(l, 'overexposed') THEN [x for x in l if x <> 'overexposed'] ELSE l END, '|') AS degradations,
 round(CASE WHEN us < 0.4 / 0.85 THEN 0.15 + sqrt(us * 0.85 * 0.4) ELSE 1.0 - sqrt((1 - us) * 0.85 * 0.45) END, 3) AS severity FROM u JOIN p USING (path)""")
def corruption_plan(t):
    plan = S.weighted_draw(t.photos.select("path"), ["path"], S.CORRUPTION_WEIGHTS, 9)
    sev = S.triangular(uniform("9#s", "path"), 0.15, 0.55, 1.0)
    return plan.select("path", F.array_join("chosen", "|").alias("degradations"), F.round(sev, 3).alias("severity"))


@query("h01_rank_bands_in_market", "listings", """
r AS (SELECT listing_id, market, row_number() OVER (PARTITION BY market ORDER BY km, listing_id) AS rk, count(*) OVER (PARTITION BY market) AS n FROM listings WHERE km IS NOT NULL)
SELECT l.listing_id, CASE WHEN rk IS NULL THEN 'unknown' ELSE 'd' || CAST(greatest(1, (10 * (rk - 1) + n - 2) // (n - 1)) AS VARCHAR) END AS km_decile,
 CASE WHEN rk IS NULL THEN 'unknown' ELSE ['low','mid','high'][CAST(greatest(1, (3 * (rk - 1) + n - 2) // (n - 1)) AS INTEGER)] END AS km_tercile
FROM listings l LEFT JOIN r USING (listing_id)""")
def market_bands(t):
    df = t.listings.select("listing_id", "market", "km")
    order = [F.col("km"), F.col("listing_id")]
    ranked = R.grouped_positions(df.where("km is not null"), ["market"], order, "_rk", "_n")

    def edge(q):
        return F.when(F.col("_n") >= q, F.expr(f"greatest(1, ({q} * (_rk - 1) + _n - 2) div greatest(_n - 1, 1))"))

    known = ranked.select("listing_id", F.concat(F.lit("d"), edge(10).cast("string")).alias("km_decile"),
                          F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), edge(3).cast("int")).alias("km_tercile"))
    unknown = df.where("km is null").select("listing_id", F.lit("unknown").alias("km_decile"), F.lit("unknown").alias("km_tercile"))
    return known.na.fill("unknown", ["km_decile", "km_tercile"]).unionByName(unknown)


@query("h02_decile_by_first_position", "listings", """
SELECT listing_id, least(9, (rank() OVER (PARTITION BY market ORDER BY km) - 1) * 10 // count(*) OVER (PARTITION BY market)) AS decile FROM listings WHERE km IS NOT NULL""")
def first_position_decile(t):
    df = t.listings.where("km is not null").select("listing_id", "market", "km")
    ranked = R.rank_with_ties(df, ["market"], "km", "r")
    sizes = df.groupBy("market").agg(F.count("*").alias("n"))
    return ranked.join(sizes, "market").select("listing_id", F.expr("least(9, cast(r_low - 1 as bigint) * 10 div n)").alias("decile"))


@query("h03_average_tie_rank", "listings", """
SELECT listing_id, rank() OVER (ORDER BY km) + (count(*) OVER (PARTITION BY km) - 1) / 2.0::DOUBLE AS rank_km FROM listings WHERE km IS NOT NULL""")
def tie_rank(t):
    df = t.listings.where("km is not null").select("listing_id", "km")
    return R.rank_with_ties(df, [], "km", "rank_km").select("listing_id", "rank_km")
