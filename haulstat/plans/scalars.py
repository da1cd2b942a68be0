"""Row-local rules over adverts, photos, findings and boxes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, condition as C, listings as L, photos as P, text as T
from .registry import query

# Known makes, their usual spelling, gallery spellings, wear-band edges.
MAKES = ["Mercedes-Benz Trucks", "Mercedes-Benz", "MAN", "Scania", "DAF", "Volvo",
         "Renault Trucks", "Renault", "Iveco", "Ford Trucks", "Ford", "Fuso",
         "Mitsubishi", "Isuzu", "Nissan", "Tatra", "Sisu", "Kamaz", "Hyundai"]
CANONICAL = {"Mercedes-Benz Trucks": "Mercedes-Benz", "Renault Trucks": "Renault", "Ford Trucks": "Ford"}
MAKE_FIXUPS = {"WESTERN STAR": "Western Star", "MAN": "MAN", "DAF": "DAF"}
WEAR_EDGES = [(150000, "low"), (400000, "mid"), (800000, "high"), (None, "very_high")]


@query("b02_title_make_model", oracle="""
t AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Mercedes-Benz Trucks ' WHEN 1 THEN 'ford trucks - ' WHEN 2 THEN 'MAN '
   WHEN 3 THEN 'Renault ' ELSE 'Krone  ' END || s_name AS title FROM supplier),
m(known, canon) AS (VALUES ('Mercedes-Benz Trucks','MERCEDES-BENZ'),('Mercedes-Benz','MERCEDES-BENZ'),('MAN','MAN'),('Scania','SCANIA'),
 ('DAF','DAF'),('Volvo','VOLVO'),('Renault Trucks','RENAULT'),('Renault','RENAULT'),('Iveco','IVECO'),('Ford Trucks','FORD'),('Ford','FORD')),
h AS (SELECT s_suppkey, regexp_replace(title, '\\s+', ' ', 'g') AS title,
   (SELECT max(length(known)) FROM m WHERE starts_with(lower(regexp_replace(t.title, '\\s+', ' ', 'g')), lower(known))) AS len FROM t)
SELECT s_suppkey, CASE WHEN len IS NULL THEN upper(split_part(title, ' ', 1))
   ELSE (SELECT canon FROM m WHERE lower(known) = lower(substr(h.title, 1, h.len))) END AS make,
 CASE WHEN len IS NULL THEN substr(title, length(split_part(title, ' ', 1)) + 2) ELSE trim(substr(title, len + 1), ' -') END AS model
FROM h""")
def title_make_model(t):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("Mercedes-Benz Trucks ", "ford trucks - ", "MAN ", "Renault ", "Krone  ")]),
                        (F.col("s_suppkey") % 5 + 1).cast("int"))
    make, model = L.split_title(F.concat(lead, "s_name"), MAKES, CANONICAL)
    return t.supplier.select("s_suppkey", make.alias("make"), model.alias("model"))


@query("b03_digits_and_year", oracle="""
SELECT page_id, TRY_CAST(nullif(regexp_replace(url, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits,
 CAST(nullif(regexp_extract(html, '((?:19|20)\\d{2})', 1), '') AS INTEGER) AS first_year FROM pages""")
def digits_and_year(t):
    return t.pages.select("page_id", L.digits_int(F.col("url")).alias("digits"),
                          L.first_year(F.col("html")).alias("first_year"))


@query("b04_miles_to_km", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(l_quantity * 12345 * 1.609344::DOUBLE, 0) AS BIGINT) AS km FROM lineitem""")
def miles(t):
    km = L.miles_to_km(F.col("l_quantity") * 12345).cast("bigint")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", km.alias("km"))


@query("b05_price_to_usd", "listings", """
SELECT listing_id, currency, CASE WHEN price IS NULL OR price = 0 THEN NULL WHEN currency = 'USD' THEN round(price, 2)
 WHEN currency = 'TRY' THEN round(price / 48.596::DOUBLE, 2) END AS price_usd FROM listings""")
def to_usd(t):
    return t.listings.select("listing_id", "currency", L.price_usd(F.col("price"), F.col("currency")).alias("price_usd"))


@query("b06_brand_normal_form", "listings", """
SELECT listing_id, CASE WHEN b IN ('FORD TRUCKS','FORD TRUCK') THEN 'FORD' WHEN b IN ('MERCEDES','MERCEDES BENZ') THEN 'MERCEDES-BENZ'
 WHEN b = '' THEN 'other' ELSE b END AS brand
FROM (SELECT listing_id, upper(trim(CASE make WHEN 'Brand#1' THEN ' ford trucks' WHEN 'Brand#2' THEN 'Mercedes Benz ' WHEN 'Brand#3' THEN '' ELSE make END)) AS b FROM listings)""")
def brand_form(t):
    raw = F.when(F.col("make") == "Brand#1", " ford trucks").when(F.col("make") == "Brand#2", "Mercedes Benz ").when(
        F.col("make") == "Brand#3", "").otherwise(F.col("make"))
    return t.listings.select("listing_id", L.normal_brand(raw).alias("brand"))


@query("b08_emission_norm", "listings", """
SELECT listing_id, CASE WHEN euro_norm IS NOT NULL AND euro_norm <> '' THEN euro_norm WHEN year >= 2016 THEN 'Euro 6'
 WHEN year >= 2009 THEN 'Euro 5' WHEN year >= 2006 THEN 'Euro 4' ELSE 'Euro 3' END AS norm,
 euro_norm IS NULL OR euro_norm = '' AS inferred FROM (SELECT listing_id, euro_norm, year - 8 AS year FROM listings)""")
def emission_norm(t):
    stated = F.col("euro_norm")
    return t.listings.select("listing_id", L.euro_norm(F.col("year") - 8, stated).alias("norm"),
                             (stated.isNull() | (stated == "")).alias("inferred"))


@query("b09_feature_row", "listings", """
SELECT listing_id, round(ln(1 + greatest(2026 - year, 0)), 4) AS log1p_age, round(ln(greatest(km, 1000)), 4) AS log_km,
 CAST(market = 'TR' AS INTEGER) AS market_tr, CAST(market = 'EU' AS INTEGER) AS market_eu,
 CAST(coalesce(nullif(euro_norm, ''), CASE WHEN year >= 2016 THEN 'Euro 6' ELSE 'Euro 5' END) = 'Euro 6' AS INTEGER) AS euro6
FROM listings WHERE km IS NOT NULL""")
def feature_row(t):
    cols = L.feature_columns(F.col("year"), F.col("km"))
    norm = L.euro_norm(F.col("year"), F.col("euro_norm"))
    return t.listings.where("km is not null").select(
        "listing_id", *[F.round(c, 4).alias(n) for n, c in cols.items()],
        (F.col("market") == "TR").cast("int").alias("market_tr"),
        (F.col("market") == "EU").cast("int").alias("market_eu"),
        (norm == "Euro 6").cast("int").alias("euro6"))


@query("b11_spec_group_key", "listings", """
SELECT market || '|' || upper(make) || '|' || model || '|' || CAST(year AS VARCHAR) || '|' || CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) AS spec_group,
 count(*) AS n FROM listings GROUP BY 1""")
def spec_groups(t):
    key = L.spec_group(F.col("market"), L.normal_brand(F.col("make")), F.col("model"), F.col("year"), F.col("price"))
    return t.listings.groupBy(key.alias("spec_group")).agg(F.count("*").alias("n"))


@query("b12_integrity_filter", "photos", """
SELECT path, CASE WHEN least(width, height) < 200 OR width * height < 120000 THEN 'drop_too_small'
 WHEN NOT (width * 1.0 / height BETWEEN 0.3 AND 3.5) THEN 'drop_aspect' END AS drop_reason FROM photos""")
def integrity(t):
    return t.photos.select("path", P.drop_reason(F.col("width"), F.col("height")).alias("drop_reason"))


QUALITY_SQL = """0.36 * least(1.0, ln(1 + blur) / ln(1201.0)) + 0.22 * (1 - least(1.0, abs(brightness - 0.45) / 0.45))
 + 0.18 * (1 - least(1.0, (dark_frac + bright_frac) * 4)) + 0.14 * least(1.0, contrast / 0.25)
 + 0.10 * least(1.0, width * height / 1920000.0)"""


def quality(df):
    c = F.col
    return df.withColumn("capture_quality", P.capture_quality(
        c("blur"), c("brightness"), c("dark_frac"), c("bright_frac"), c("contrast"), c("width"), c("height")))


@query("b13_capture_quality", "photos", f"SELECT path, round({QUALITY_SQL}, 4) AS capture_quality FROM photos")
def capture_quality(t):
    return quality(t.photos).select("path", "capture_quality")


@query("b15_capture_verdict", "photos", """
SELECT path, NOT (blur < 34 OR brightness < 0.0824 OR dark_frac > 0.6384 OR brightness > 0.7514 OR bright_frac > 0.1727 OR contrast < 0.0858) AS usable,
 concat_ws(',', CASE WHEN blur < 34 THEN 'blurry' WHEN blur < 122.4 THEN 'soft_focus' END,
  CASE WHEN brightness < 0.0824 OR dark_frac > 0.6384 THEN 'underexposed' END,
  CASE WHEN brightness > 0.7514 OR bright_frac > 0.1727 THEN 'blown_out' END, CASE WHEN contrast < 0.0858 THEN 'flat' END) AS reasons FROM photos""")
def capture_verdict(t):
    c = F.col
    found = t.photos.withColumn("found", P.capture_reasons(c("blur"), c("brightness"), c("contrast"), c("dark_frac"), c("bright_frac")))
    return found.select("path", P.usable(F.col("found")).alias("usable"), F.concat_ws(",", "found").alias("reasons"))


@query("b16_wear_and_distance_bands", "listings", """
SELECT listing_id, CASE WHEN km < 150000 THEN 'low' WHEN km < 400000 THEN 'mid' WHEN km < 800000 THEN 'high' WHEN km IS NOT NULL THEN 'very_high' END AS wear_band,
 CAST(floor(km / w) * w AS BIGINT) AS band_low, CAST(floor(km / w) * w + w AS BIGINT) AS band_high,
 CASE WHEN km IS NULL THEN 'unstated' WHEN age <= 0 THEN 'no_basis' WHEN km > round_even(age * 71267, -4) THEN 'worked_more'
  WHEN km < round_even(age * 48981, -4) THEN 'worked_less' ELSE 'as_expected' END AS verdict
FROM (SELECT listing_id, km, 2026 - year AS age, CASE WHEN km < 500000 THEN 100000 ELSE 250000 END AS w FROM listings)""")
def wear(t):
    km = F.col("km")
    return t.listings.select("listing_id", L.wear_band(km, WEAR_EDGES).alias("wear_band"),
                             L.km_band_low(km).alias("band_low"), L.km_band_high(km).alias("band_high"),
                             L.usage_verdict(L.REF_YEAR - F.col("year"), km).alias("verdict"))


@query("b17_content_words", "findings", """
SELECT listing_id, photo_id, len([x for x in list_distinct(regexp_extract_all(lower(observation), '[a-z]{4,}'))
 if NOT list_contains(['with','without','from','that','this','there','here','which','where','when','were','have','some','both','visible','appears','appear','shows','showing','seen','photo','image','frame','side','across','along','around','near','over','under','than','more','most','less','very','rather','still'], x)]) AS n_words FROM findings""")
def content_words(t):
    return t.findings.select("listing_id", "photo_id", F.size(T.content_words(F.col("observation"))).cast("bigint").alias("n_words"))


@query("b18_hash_distance", "photos twins", """
SELECT p.path, CAST(bit_count(xor(('0x' || substr(p.phash,1,8))::BIGINT, ('0x' || substr(x.phash,1,8))::BIGINT))
 + bit_count(xor(('0x' || substr(p.phash,9,8))::BIGINT, ('0x' || substr(x.phash,9,8))::BIGINT)) AS INTEGER) AS bits
FROM photos p JOIN twins x ON x.clean_path = p.path""")
def hash_distance(t):
    other = t.twins.select(F.col("clean_path").alias("path"), F.col("phash").alias("other"))
    return t.photos.join(other, "path").select("path", P.hamming64(F.col("phash"), F.col("other")).alias("bits"))


PLATE_SQL = """
p AS (SELECT c_custkey, lpad(CAST(c_custkey % 95 AS VARCHAR), 2, '0') || ' kr-' || CAST(c_custkey AS VARCHAR) AS raw FROM customer)"""


@query("b21_plate_normal_form", oracle=PLATE_SQL + """
SELECT c_custkey, plate, regexp_full_match(plate, '[0-9]{2}([A-Z][0-9]{4}|[A-Z]{2}[0-9]{3,4}|[A-Z]{3}[0-9]{2,3})')
 AND CAST(substr(plate, 1, 2) AS INTEGER) BETWEEN 1 AND 81 AS plausible
FROM (SELECT c_custkey, replace(replace(upper(raw), ' ', ''), '-', '') AS plate FROM p)""")
def plate_form(t):
    lead = F.lpad((F.col("c_custkey") % 95).cast("string"), 2, "0")
    plate = codes.normal_plate(F.concat(lead, F.lit(" kr-"), F.col("c_custkey").cast("string")))
    return t.customer.select("c_custkey", plate.alias("plate"), codes.plausible_plate(plate, F.lit("TR")).alias("plausible"))


@query("b22_vin_audit", oracle="""
v AS (SELECT o_orderkey, upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 17)) AS vin FROM orders),
w AS (SELECT o_orderkey, vin, list_sum([
  (CASE substr(vin, i, 1) WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 WHEN 'E' THEN 5 WHEN 'F' THEN 6 ELSE CAST(substr(vin, i, 1) AS INTEGER) END)
  * [8,7,6,5,4,3,2,10,0,9,8,7,6,5,4,3,2][i] for i in range(1, 18)]) % 11 AS r FROM v)
SELECT o_orderkey, vin, substr(vin, 9, 1) = CASE CAST(r AS INTEGER) WHEN 10 THEN 'X' ELSE CAST(CAST(r AS INTEGER) AS VARCHAR) END AS check_ok,
 substr(vin, 1, 1) IN ('1','2','3','4','5') AS north_american,
 CASE WHEN substr(vin, 1, 1) IN ('1','2','3','4','5') AND strpos('ABCDEFGHJKLMNPRSTVWXY123456789', substr(vin, 10, 1)) > 0
  THEN CAST(CASE WHEN substr(vin, 7, 1) BETWEEN '0' AND '9' THEN 1979 ELSE 2009 END + strpos('ABCDEFGHJKLMNPRSTVWXY123456789', substr(vin, 10, 1)) AS INTEGER) END AS model_year
FROM w""")
def vin_audit(t):
    vin = F.upper(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 17))
    return t.orders.select("o_orderkey", vin.alias("vin")).select(
        "o_orderkey", "vin", codes.vin_check_ok(F.col("vin")).alias("check_ok"),
        codes.north_american(F.col("vin")).alias("north_american"),
        codes.vin_model_year(F.col("vin")).alias("model_year"))


@query("b23_market_and_make_spelling", "listings", """
SELECT listing_id, CASE WHEN market IN ('TR','US') THEN market WHEN starts_with(source_key, 'tr_') THEN 'TR' ELSE 'US' END AS lot,
 CASE WHEN make = 'Brand#4' THEN 'Unknown' WHEN make = 'Brand#5' THEN 'MAN' ELSE upper(substr(make, 1, 1)) || lower(substr(make, 2)) END AS spelled FROM listings""")
def spelling(t):
    raw = F.when(F.col("make") == "Brand#4", "nan").when(F.col("make") == "Brand#5", "man").otherwise(F.col("make"))
    return t.listings.select("listing_id", L.home_market(F.col("market"), F.col("source_key")).alias("lot"),
                             L.pretty_make(raw, MAKE_FIXUPS).alias("spelled"))


@query("f08_finding_demerit", "findings", """
SELECT listing_id, photo_id, round(CASE WHEN ungraded THEN 0 ELSE
 coalesce(CASE severity WHEN 'cosmetic' THEN 0.15 WHEN 'minor' THEN 0.4 WHEN 'moderate' THEN 1.0 WHEN 'major' THEN 2.2 END
 * CASE price_impact WHEN 'none' THEN 0.0 WHEN 'low' THEN 0.4 WHEN 'medium' THEN 1.0 WHEN 'high' THEN 2.0 END
 * greatest(0.2, least(1.0, coalesce(confidence, 0.3))), 0) END::DOUBLE, 4) AS demerit FROM findings""")
def demerit(t):
    value = C.demerit(F.col("severity"), F.col("price_impact"), F.col("confidence"), F.col("ungraded"))
    return t.findings.select("listing_id", "photo_id", F.round(value, 4).alias("demerit"))
