"""Domain tables derived from the given tables, in SQL that Spark and DuckDB both read.

Every statement scans its whole input, so the derived tables grow with it.
"""

VIEW_CASE = """CASE ({e}) % 11 WHEN 0 THEN 'exterior_front_34' WHEN 1 THEN 'tire_wheel'
 WHEN 2 THEN 'dashboard_odometer' WHEN 3 THEN 'exterior_side' WHEN 4 THEN 'interior_cab'
 WHEN 5 THEN 'chassis_undercarriage' WHEN 6 THEN 'fifth_wheel' WHEN 7 THEN 'engine_bay'
 WHEN 8 THEN 'damage_detail' WHEN 9 THEN 'exterior_front' ELSE 'exterior_rear' END"""

STANDINS: dict[str, str] = {}

# One row per (order, line): an advert with price, age, distance, make, model, dealer.
STANDINS["listings"] = """
SELECT CASE r.r_name WHEN 'ASIA' THEN 'tr_market' WHEN 'EUROPE' THEN 'eu_market' ELSE 'us_market' END AS source_key,
 CAST(l.ok AS STRING) || '-' || CAST(l.ln AS STRING) AS listing_id,
 CASE r.r_name WHEN 'ASIA' THEN 'TR' WHEN 'EUROPE' THEN 'EU' ELSE 'US' END AS market,
 p.p_brand AS make, p.p_type AS model,
 CAST(year(o.o_orderdate) + 20 AS INT) AS year,
 CASE WHEN l.qty = 13 THEN NULL ELSE l.qty * 20000 END AS km,
 l.price AS price,
 CASE WHEN l.qty = 17 THEN 'SEK' WHEN r.r_name = 'ASIA' THEN 'TRY' WHEN r.r_name = 'EUROPE' THEN 'EUR' ELSE 'USD' END AS currency,
 CASE WHEN l.pk % 7 = 0 THEN 'Euro 6' WHEN l.pk % 7 = 1 THEN '' ELSE NULL END AS euro_norm,
 s.s_name AS dealer_name, CAST(1 + (l.ok * 7 + l.ln) % 40 AS INT) AS n_images,
 p.p_size AS size_class, p.p_retailprice AS retail, o.o_orderpriority AS seller_tier
FROM (SELECT l_orderkey AS ok, l_linenumber AS ln, max(l_partkey) AS pk, max(l_suppkey) AS sk,
        max(l_quantity) AS qty, max(l_extendedprice) AS price
      FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l
JOIN {orders} o ON o.o_orderkey = l.ok
JOIN {part} p ON p.p_partkey = l.pk
JOIN {supplier} s ON s.s_suppkey = l.sk
JOIN {nation} n ON n.n_nationkey = s.s_nationkey
JOIN {region} r ON r.r_regionkey = n.n_regionkey
"""

_PHOTO = """
SELECT source AS source_key, CAST(CAST(floor(doc_id / 200) AS BIGINT) AS STRING) AS listing_id,
 CAST(doc_id % 200 AS INT) AS image_index, 'original' AS variant,
 substr(md5(text), 1, 16) AS phash,
 CAST(150 + (doc_id * 37 + n_chars) % 1900 AS INT) AS width,
 CAST(150 + (doc_id * 53 + n_chars) % 1500 AS INT) AS height,
 CAST((n_chars * 7) % 1600 AS DOUBLE) AS blur,
 CAST((doc_id * 17 + n_chars) % 100 AS DOUBLE) / 100 AS brightness,
 CAST((doc_id * 23 + n_chars) % 40 AS DOUBLE) / 100 AS contrast,
 CAST((doc_id * 11) % 30 AS DOUBLE) / 100 AS dark_frac,
 CAST((doc_id * 13 + n_chars) % 20 AS DOUBLE) / 100 AS bright_frac,
 """ + VIEW_CASE.format(e="doc_id * 7 + n_chars") + """ AS view,
 CAST((doc_id * 41 + n_chars) % 100 AS DOUBLE) / 100 AS view_conf,
 CASE (doc_id * 3 + n_chars) % 12 WHEN 0 THEN 'reject_document' WHEN 1 THEN 'reject_screen' ELSE 'keep' END AS content_label,
 source || '/' || CAST(doc_id AS STRING) AS path,
 CASE lang WHEN 'en' THEN 'US' WHEN 'de' THEN 'EU' ELSE 'TR' END AS market,
 doc_id
FROM {documents}
"""
STANDINS["photos"] = _PHOTO

# A degraded copy of every photo: lower metrics, a severity and a recipe.
STANDINS["twins"] = """
SELECT source_key, listing_id, image_index, 'degraded' AS variant,
 'd' || substr(phash, 2, 15) AS phash, width, height, blur * 0.4 AS blur, brightness * 0.7 AS brightness,
 contrast * 0.8 AS contrast, dark_frac, bright_frac, view, view_conf, content_label,
 path || '_deg' AS path, path AS clean_path, market, doc_id,
 CAST((doc_id * 29) % 100 AS DOUBLE) / 100 AS severity,
 CASE doc_id % 3 WHEN 0 THEN 'motion_blur|rain' WHEN 1 THEN 'defocus|jpeg_crush' ELSE 'rain|jpeg_crush' END AS degradations
FROM {photos} WHERE doc_id % 9 <> 4
"""

# Vehicle boxes: a photo is an order, a box is one of its lines.
STANDINS["boxes"] = """
SELECT CAST(CAST(floor(l_orderkey / 8) AS BIGINT) AS STRING) AS listing_id, l_orderkey AS photo_id, box_id, label,
 confidence, x1, y1, least(x1 + w, 1000.0) AS x2, least(y1 + h, 800.0) AS y2,
 (least(x1 + w, 1000.0) - x1) * (least(y1 + h, 800.0) - y1) / 800000 AS area_frac
FROM (SELECT l_orderkey,
  CAST(l_linenumber AS BIGINT) * 10000000000000 + l_partkey * 100000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 2 ELSE 4 END + CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS box_id,
  CASE l_returnflag WHEN 'A' THEN 'truck' WHEN 'R' THEN 'car' ELSE CASE l_linestatus WHEN 'O' THEN 'bus' ELSE 'motorcycle' END END AS label,
  l_quantity / 50 AS confidence,
  CAST((l_partkey % 5) * 60 AS DOUBLE) AS x1, CAST((l_suppkey % 4) * 50 AS DOUBLE) AS y1,
  CAST(100 + (l_partkey * 3 + l_linenumber) % 700 AS DOUBLE) AS w,
  CAST(100 + (l_suppkey * 7 + l_linenumber) % 500 AS DOUBLE) AS h
 FROM {lineitem}
 GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity) b
"""

# Readings of raters: unit = (user, day), rater = event type, level 0..3.
STANDINS["ratings"] = """
SELECT CAST(user_id AS STRING) || ':' || CAST(CAST(ts AS DATE) AS STRING) AS unit,
 CAST(user_id AS STRING) AS vehicle, event_type AS rater,
 max(CASE WHEN value < 5 THEN 0 WHEN value < 30 THEN 1 WHEN value < 80 THEN 2 ELSE 3 END) AS level,
 max(CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END) AS hidden,
 min(event_id) AS seq
FROM {events} GROUP BY 1, 2, 3
"""

# Findings: one per turn of a conversation.
STANDINS["findings"] = """
SELECT CAST(conv_id AS STRING) AS listing_id, CAST(turn AS INT) AS photo_id, CAST(turn % 3 AS INT) AS sample,
 CAST(turn AS INT) AS pos, text AS observation,
 CASE (conv_id + turn) % 7 WHEN 0 THEN 'corrosion' WHEN 1 THEN 'chassis_frame' WHEN 2 THEN 'engine_bay'
  WHEN 3 THEN 'fluid_leaks' WHEN 4 THEN 'drive_tires' WHEN 5 THEN 'paint_finish' ELSE 'gearbox' END AS component,
 CASE (conv_id * 3 + turn) % 5 WHEN 0 THEN 'cosmetic' WHEN 1 THEN 'minor' WHEN 2 THEN 'moderate' WHEN 3 THEN 'major' ELSE 'grave' END AS severity,
 CASE (conv_id + turn * 2) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS price_impact,
 CASE WHEN (conv_id + turn) % 17 = 0 THEN NULL ELSE CAST((conv_id * 31 + turn * 7) % 101 AS DOUBLE) / 100 END AS confidence,
 (conv_id + turn) % 13 = 0 AS ungraded, (conv_id + turn) % 5 = 0 AS seen_twice
FROM {conversations}
"""

# Reads of one photo, with whether it was legible and what it affirmed.
STANDINS["reads"] = """
SELECT CAST(conv_id AS STRING) AS listing_id, CAST(turn AS INT) AS photo_id,
 """ + VIEW_CASE.format(e="conv_id + turn * 5") + """ AS view,
 (conv_id + turn) % 6 <> 0 AS legible, (conv_id + turn) % 3 = 0 AS affirmed,
 CASE WHEN (conv_id + turn) % 19 = 0 THEN 'timeout' ELSE '' END AS error
FROM {conversations}
"""

# Metrics of two runs (first and second half of the month), one suite per event type.
STANDINS["metric_units"] = """
SELECT CASE WHEN day(ts) <= 15 THEN 'before' ELSE 'after' END AS run, event_type AS suite,
 CAST(user_id AS STRING) AS unit, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS hits
FROM {events} GROUP BY 1, 2, 3
"""

# Repeated sightings: three wordings of every observation on the original and on its degraded copy.
STANDINS["sightings"] = """
SELECT CAST(c.conv_id AS STRING) AS unit, v.variant, v.sample, CAST(c.turn AS INT) AS pos,
 CASE (c.conv_id + c.turn) % 4 WHEN 0 THEN 'corrosion' WHEN 1 THEN 'chassis_frame' WHEN 2 THEN 'engine_bay' ELSE 'fluid_leaks' END AS component,
 CASE (c.conv_id + c.turn) % 4 WHEN 0 THEN 'frame_corrosion' WHEN 1 THEN 'frame_corrosion' ELSE 'engine_leaks' END AS family,
 CASE v.variant WHEN 'original' THEN CASE v.sample WHEN 0 THEN c.text WHEN 1 THEN replace(c.text, 'er', ' ') ELSE replace(c.text, 'en', ' ') END
  ELSE CASE v.sample WHEN 0 THEN replace(c.text, 'th', ' ') WHEN 1 THEN replace(c.text, 'on', ' ') ELSE replace(c.text, 'e', ' ') END END AS observation,
 CASE (c.conv_id * 3 + c.turn + v.sample) % 4 WHEN 0 THEN 'cosmetic' WHEN 1 THEN 'minor' WHEN 2 THEN 'moderate' ELSE 'major' END AS severity,
 CASE (c.conv_id + c.turn * 2 + v.sample) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS price_impact,
 CAST((c.conv_id * 31 + c.turn * 7 + v.sample * 11) % 101 AS DOUBLE) / 100 AS confidence
FROM {conversations} c CROSS JOIN (SELECT 'original' AS variant, 0 AS sample UNION ALL SELECT 'original', 1 UNION ALL SELECT 'original', 2
 UNION ALL SELECT 'degraded', 0 UNION ALL SELECT 'degraded', 1 UNION ALL SELECT 'degraded', 2) v
"""

# What each source says about an order's make: at most one opinion per source.
STANDINS["witnesses"] = """
SELECT CAST(l_orderkey AS STRING) AS listing_id,
 CASE l_linenumber % 4 WHEN 0 THEN 'wmi' WHEN 1 THEN 'badge' WHEN 2 THEN 'identity_pass' ELSE 'head' END AS source,
 max('BRAND#' || CAST(l_partkey % 3 AS STRING)) AS brand, max(CAST(40 + (l_partkey * 7 + l_suppkey) % 61 AS DOUBLE) / 100) AS conf
FROM {lineitem} GROUP BY 1, 2
"""

# Repeated identity reads of one unit: a make or an abstention, and whether the set shows one vehicle.
STANDINS["identity_reads"] = """
SELECT CAST(user_id AS STRING) || ':' || CAST(CAST(ts AS DATE) AS STRING) AS unit, CAST(event_id AS BIGINT) AS sample,
 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Ford Trucks' WHEN 2 THEN ' ford ' WHEN 3 THEN 'MAN' ELSE 'Mercedes' END AS make,
 event_id % 3 <> 0 AS same_vehicle, CASE event_id % 4 WHEN 0 THEN '' ELSE 'badge' || CAST(event_id % 4 AS STRING) END AS badge
FROM {events}
"""

# Text found on dashboards: digits with a unit, bare digits, lone units.
STANDINS["tokens"] = """
SELECT l_orderkey AS photo_id, CAST(floor(l_orderkey / 8) AS BIGINT) AS listing_id, l_linenumber AS kind,
 CAST(l_linenumber AS BIGINT) * 10000000000000 + l_partkey * 100000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 2 ELSE 4 END + CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS pos,
 CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_quantity * 9000 AS INT) AS STRING) || CASE WHEN l_partkey % 3 = 0 THEN 'mi' ELSE 'km' END
  WHEN 1 THEN CAST(CAST(l_quantity * 9000 AS INT) AS STRING) WHEN 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'km' ELSE 'km/h' END ELSE 'rpm' END AS text,
 CAST(50 + (l_partkey + l_suppkey) % 50 AS DOUBLE) / 100 AS conf,
 CAST((l_partkey % 4) * 30 + CASE l_linenumber % 4 WHEN 2 THEN 70 ELSE 0 END AS DOUBLE) AS x1, CAST((l_suppkey % 3) * 8 AS DOUBLE) AS y1,
 CAST((l_partkey % 4) * 30 + CASE l_linenumber % 4 WHEN 2 THEN 70 ELSE 0 END + 40 AS DOUBLE) AS x2, CAST((l_suppkey % 3) * 8 + 12 AS DOUBLE) AS y2
FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus
"""

# Records by plate, several per plate for some, with events.
STANDINS["registry"] = """
SELECT CAST(c_custkey % 1000 AS STRING) AS plate, CASE WHEN c_nationkey % 5 = 0 THEN 'DE' ELSE 'TR' END AS country, c_custkey AS record_id,
 CASE WHEN c_custkey % 11 = 0 THEN 'BAD' ELSE upper(substr(md5(CAST(c_custkey AS STRING)), 1, 17)) END AS vin,
 CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'registry' END AS source, CAST(c_custkey % 45 - 5 AS INT) AS age_days, c_custkey % 7 <> 0 AS commercial
FROM {customer}
"""
STANDINS["registry_events"] = """
SELECT o_custkey AS record_id, o_orderkey AS event_id, CASE o_orderkey % 9 WHEN 0 THEN 'flood' WHEN 1 THEN 'inspection' ELSE 'accident' END AS type,
 CASE o_orderkey % 4 WHEN 0 THEN 'minor' WHEN 1 THEN 'moderate' WHEN 2 THEN 'major' ELSE 'unknown' END AS severity, o_orderkey % 10 <> 0 AS repaired
FROM {orders}
"""
