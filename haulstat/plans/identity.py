"""Identity, odometer, history and gate queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..functions import listings as L
from ..operators import corpus as K
from ..operators import gate as G
from ..operators import identity as I
from ..session import cut_lineage
from .registry import query
from .scalars import QUALITY_SQL

UNIT = ["unit"]


@query("f01_identity_vote", "identity_reads", """
k AS (SELECT *, CASE upper(trim(make)) WHEN 'FORD TRUCKS' THEN 'FORD' WHEN 'MERCEDES' THEN 'MERCEDES-BENZ' ELSE upper(trim(make)) END AS f FROM identity_reads),
v AS (SELECT unit, f, count(*) AS n, min(sample) AS s FROM k WHERE f IS NOT NULL GROUP BY 1, 2), r AS (SELECT unit, count(*) AS reads FROM k GROUP BY 1),
b AS (SELECT unit, arg_max(f, {'n': n, 's': -s}) AS answer, max(n) AS votes, count(*) AS d FROM v GROUP BY 1)
SELECT r.unit, reads, answer, coalesce(votes, 0) AS votes, round(coalesce(votes, 0) / reads, 3) AS agreement, coalesce(d, 0) > 1 AS disagreement FROM r LEFT JOIN b USING (unit)""")
def identity_vote(t):
    return I.field_vote(t.identity_reads, UNIT, "make", F.when(F.col("make").isNotNull(), L.normal_brand(F.col("make"))), "sample")


@query("f01_badges_by_support", "identity_reads", """
s AS (SELECT unit, upper(badge) AS badge, count(*) AS support, min(sample) AS f FROM identity_reads WHERE badge <> '' GROUP BY 1, 2)
SELECT unit, badge, support, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY support DESC, f) AS place FROM s) WHERE place <= 8""")
def badges(t):
    return I.supported_badges(t.identity_reads, UNIT, "badge", "sample")


@query("f02_same_vehicle_quorum", "identity_reads", """
SELECT unit, count(*) AS reads, count_if(NOT same_vehicle) AS dissent, count_if(NOT same_vehicle) < greatest(1, least(2, count(*))) AS same_vehicle,
 count_if(NOT same_vehicle) > 0 AND count_if(NOT same_vehicle) < count(*) AS split FROM identity_reads GROUP BY 1""")
def same_vehicle(t):
    return I.same_vehicle(t.identity_reads, UNIT, "same_vehicle", 2)


FUSE_SQL = """
p AS (SELECT *, CASE source WHEN 'wmi' THEN 1.0 WHEN 'badge' THEN 0.8 WHEN 'identity_pass' THEN 0.7 ELSE 0.45 END::DOUBLE * conf AS w, list_position(['identity_pass', 'badge', 'wmi', 'head'], source) AS o FROM witnesses WHERE conf >= 0.6),
s AS (SELECT listing_id, brand, round(sum(w), 9) AS score, count(*) AS n, min(o) AS f, bool_or(source = 'wmi') AS plate FROM p GROUP BY 1, 2),
b AS (SELECT listing_id, arg_max(brand, {'s': score, 'f': -f}) AS make, arg_max(n, {'s': score, 'f': -f}) AS n, max(score) AS top, sum(score) AS total, count(*) AS brands, bool_or(plate) AS plate FROM s GROUP BY 1),
fused AS (SELECT u.listing_id, make, CASE WHEN make IS NULL THEN 'unknown' WHEN brands > 1 THEN 'disputed' WHEN n >= 2 THEN 'confirmed' ELSE 'probable' END AS status, coalesce(round(round(top / total, 9), 3), 0) AS confidence,
 CASE WHEN make IS NULL THEN 1.35 WHEN brands > 1 AND plate THEN 1.2 WHEN brands > 1 THEN 1.25 ELSE 1.0 END::DOUBLE AS widening FROM (SELECT DISTINCT listing_id FROM witnesses) u LEFT JOIN b USING (listing_id))"""


def fused(t):
    w = t.witnesses
    return I.fuse_witnesses(w, w.select("listing_id").distinct(), ["listing_id"])


@query("f14_witness_fusion", "witnesses", FUSE_SQL + " SELECT * FROM fused")
def witness_fusion(t):
    return fused(t)


@query("f15_widening_list", "witnesses", FUSE_SQL + """
SELECT listing_id, CASE WHEN CAST(listing_id AS BIGINT) % 2 = 0 THEN 'odometer' ELSE 'odometer,missing view' END AS kept,
 round(1.25 * CASE WHEN CAST(listing_id AS BIGINT) % 2 = 0 THEN 1 ELSE 1.12 END * widening, 4) AS factor FROM fused""")
def widening_list(t):
    row = lambda label, factor: F.struct(F.lit(label).alias("label"), F.lit(factor).alias("factor"))
    odd = F.col("listing_id").cast("bigint") % 2 == 1
    entries = F.filter(F.array(row("odometer", 1.25), row("identity disputed between the badge read and the head", 1.25),
                               F.when(odd, row("missing view", 1.12))), lambda e: e.isNotNull())
    kept, product = I.merged_widening(entries, F.col("widening"), "^(identity disputed between the badge read and the|the chassis-plate WMI)")
    return fused(t).select("listing_id", F.array_join(kept, ",").alias("kept"), F.round(product, 4).alias("factor"))


@query("f22_head_against_badge", "witnesses", """
x AS (SELECT listing_id, max(CASE WHEN source = 'badge' THEN brand END) AS badge, max(CASE WHEN source = 'head' THEN brand END) AS head, max(CASE WHEN source = 'head' THEN conf END) AS conf FROM witnesses GROUP BY 1)
SELECT listing_id, badge IN ('BRAND#0', 'BRAND#1') AND head <> badge AND conf >= 0.6 AS disputed FROM x WHERE badge IS NOT NULL AND head IS NOT NULL""")
def head_against_badge(t):
    of = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    x = t.witnesses.groupBy("listing_id").agg(of("badge", "brand").alias("badge"), of("head", "brand").alias("head"), of("head", "conf").alias("conf"))
    trained = F.array(F.lit("BRAND#0"), F.lit("BRAND#1"))
    return x.where("badge is not null and head is not null").select(
        "listing_id", (F.array_contains(trained, F.col("badge")) & (F.col("head") != F.col("badge")) & (F.col("conf") >= 0.6)).alias("disputed"))


@query("d05_wmi_against_badge", oracle="""
w AS (SELECT upper(substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 3)) AS wmi, CASE s_nationkey % 3 WHEN 0 THEN 'FORD' WHEN 1 THEN 'MAN' ELSE 'DAF' END AS brand, CASE WHEN s_suppkey % 4 = 0 THEN 'VOLVO' ELSE 'none' END AS also FROM supplier WHERE s_suppkey % 5 <> 0),
k AS (SELECT wmi, list_concat(list(brand), list(also)) AS l FROM w GROUP BY 1),
v AS (SELECT o_orderkey, upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 3)) AS wmi, CASE o_custkey % 4 WHEN 0 THEN 'FORD' WHEN 1 THEN 'MAN' WHEN 2 THEN 'VOLVO' ELSE 'other' END AS badge FROM orders)
SELECT o_orderkey, wmi, CASE WHEN l IS NULL THEN 'no_opinion' WHEN badge = 'other' THEN 'no_badge' WHEN list_contains(l, badge) THEN 'agrees' ELSE 'conflict' END AS verdict FROM v LEFT JOIN k USING (wmi)""")
def wmi_against_badge(t):
    brand = F.element_at(F.array(F.lit("FORD"), F.lit("MAN"), F.lit("DAF")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    wmi = t.supplier.select(F.upper(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 3)).alias("wmi"), brand.alias("brand"),
                            F.array(F.when(F.col("s_suppkey") % 4 == 0, "Volvo").otherwise("none")).alias("also_badged"), (F.col("s_suppkey") % 5 != 0).alias("verified"))
    badge = F.element_at(F.array(F.lit("Ford Trucks"), F.lit("MAN"), F.lit("volvo"), F.lit("")), (F.col("o_custkey") % 4 + 1).cast("int"))
    vins = t.orders.select("o_orderkey", F.upper(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 17)).alias("vin"), badge.alias("badge"))
    return I.wmi_conflicts(vins, wmi).select("o_orderkey", "wmi", "verdict")


def generations(t):
    spans = F.array(F.struct(F.lit(1).alias("ord"), F.lit("first").alias("id"), F.lit(2014).alias("lo"), F.lit(2017).alias("hi")),
                    F.struct(F.lit(2).alias("ord"), F.lit("Second").alias("id"), F.lit(2017).alias("lo"), F.when(F.col("p_type") == "LARGE", 2019).alias("hi")))
    return t.part.where("p_type <> 'PROMO'").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), spans.alias("g")).distinct().select("brand", "model", F.inline("g"))


@query("d06_generation_against_year", "listings", """
SELECT listing_id, CASE WHEN model = 'PROMO' OR n_images % 5 = 4 THEN 'no_opinion' WHEN gen = 'first' THEN CASE WHEN year BETWEEN 2014 AND 2017 THEN 'agrees' WHEN model = 'LARGE' AND year > 2019 THEN 'off_the_card' ELSE 'conflict' END
  ELSE CASE WHEN year >= 2017 AND (model <> 'LARGE' OR year <= 2019) THEN 'agrees' WHEN year BETWEEN 2014 AND 2017 THEN 'conflict' ELSE 'off_the_card' END END AS verdict,
 CASE WHEN model = 'PROMO' OR n_images % 5 = 4 THEN NULL WHEN gen = 'first' AND year > 2017 AND NOT (model = 'LARGE' AND year > 2019) THEN 'Second' WHEN gen = 'second' AND year < 2017 THEN 'first' END AS expected
FROM (SELECT *, CASE WHEN n_images % 2 = 0 THEN 'first' ELSE 'second' END AS gen FROM listings)""")
def generation_against_year(t):
    read = F.when(F.col("n_images") % 5 == 4, "prototype").when(F.col("n_images") % 2 == 0, "first").otherwise("second")
    vehicles = t.listings.select("listing_id", F.col("make").alias("brand"), "model", "year", read.alias("generation"))
    return I.generation_conflicts(vehicles, generations(t), ["listing_id"])


@query("b07_model_normal_form", oracle="""
SELECT p_partkey, CASE WHEN p_brand = 'Brand#3' THEN upper(x) WHEN p_type = 'LARGE' THEN 'LRG' WHEN p_type = 'ECONOMY' AND p_size % 2 = 0 THEN 'ECO PLUS' WHEN p_type = 'ECONOMY' THEN 'ECO' ELSE upper(x) END AS canonical
FROM (SELECT *, CASE p_type WHEN 'ECONOMY' THEN CASE WHEN p_size % 2 = 0 THEN 'Eco-plus 500' ELSE 'e.co 400' END ELSE p_type || ' x' END AS x FROM part)""")
def model_normal_form(t):
    text = F.when(F.col("p_type") == "ECONOMY", F.when(F.col("p_size") % 2 == 0, "Eco-plus 500").otherwise("e.co 400")).otherwise(F.concat("p_type", F.lit(" x")))
    rows = t.part.select("p_partkey", F.col("p_brand").alias("brand"), text.alias("model"))
    names = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("alias")) for m, a in (("LRG", "large-X"), ("Eco", "ECO"), ("Eco Plus", "eco plus"))])
    cards = t.part.select(F.col("p_brand").alias("brand")).distinct().where("brand <> 'Brand#3'").select("brand", F.inline(names))
    return I.model_names(rows, cards, ["p_partkey"]).select("p_partkey", "canonical")


ODO_SQL = """
u AS (SELECT photo_id, listing_id, pos, conf, lower(text) AS x, x1, y1, x2, y2 FROM tokens),
j AS (SELECT photo_id, pos, conf, CAST(regexp_extract(x, '^([0-9]+)', 1) AS BIGINT) AS v, regexp_extract(x, '([a-z]+)$', 1) AS un, 'joined' AS rule FROM u WHERE regexp_full_match(x, '0?[0-9]{4,7}(km|mi|miles)')),
n AS (SELECT b.photo_id, b.pos, b.conf, CAST(b.x AS BIGINT) AS v, arg_min(k.x, k.pos) AS un, 'adjacent' AS rule FROM u b JOIN u k ON b.photo_id = k.photo_id AND regexp_full_match(b.x, '0?[0-9]{4,7}') AND k.x IN ('km', 'mi', 'miles')
   AND abs((k.y1 + k.y2) / 2 - (b.y1 + b.y2) / 2) < b.y2 - b.y1 AND k.x1 - b.x2 >= 0 AND k.x1 - b.x2 < 3 * (b.y2 - b.y1) GROUP BY b.photo_id, b.pos, b.conf, b.x),
c AS (SELECT photo_id, pos, conf, rule, CASE WHEN un = 'km' THEN v ELSE CAST(round_even(v * 1.60934::DOUBLE, 0) AS BIGINT) END AS km FROM (SELECT * FROM j UNION ALL SELECT * FROM n)),
d AS (SELECT * FROM c WHERE km BETWEEN 1000 AND 2000000),
cand AS (SELECT * FROM d WHERE rule = 'joined' OR photo_id NOT IN (SELECT photo_id FROM d WHERE rule = 'joined')),
best AS (SELECT photo_id, arg_max(km, {'c': conf, 'p': -pos}) AS km0, max(conf) AS conf, arg_max(rule, {'c': conf, 'p': -pos}) AS rule, count(*) AS n_candidates FROM cand GROUP BY 1)"""


@query("d12_odometer_token_pairs", "tokens", ODO_SQL + " SELECT photo_id, pos, km, rule FROM cand")
def odometer_pairs(t):
    return I.odometer_candidates(t.tokens).select("photo_id", "pos", "km", "rule")


@query("f16_odometer_best_read", "tokens", ODO_SQL + " SELECT photo_id, CASE WHEN conf >= 0.5 THEN km0 END AS km, conf, rule, n_candidates FROM best")
def odometer_best(t):
    return I.odometer_best(I.odometer_candidates(t.tokens))


@query("f17_odometer_reconciliation", "tokens", ODO_SQL + """,
r AS (SELECT CAST(floor(photo_id / 8) AS BIGINT) AS listing_id, km0 AS km, conf FROM best WHERE conf >= 0.5),
v AS (SELECT CAST(c_custkey AS BIGINT) AS listing_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey * 37 % 50) * 9000.0::DOUBLE END AS said FROM customer),
b AS (SELECT v.listing_id, said, max({'c': conf, 'k': km}).k AS ocr, max(conf) AS sure FROM v LEFT JOIN r USING (listing_id) GROUP BY 1, 2),
s AS (SELECT b.listing_id, said, ocr, sure, count_if(abs(r.km - said) <= greatest(1000, 0.02 * said)) AS fs, count_if(abs(r.km - ocr) <= greatest(1000, 0.02 * ocr)) AS fo FROM b LEFT JOIN r USING (listing_id) GROUP BY 1, 2, 3, 4),
q AS (SELECT *, CASE WHEN ocr IS NULL THEN 'silent' WHEN said IS NULL THEN 'odometer_recovered' WHEN abs(ocr - said) <= greatest(1000, 0.02 * said) OR sure < 0.8 OR fs > 0 THEN 'silent' WHEN fo >= 2 THEN 'odometer_overridden' ELSE 'odometer_conflict' END AS verdict FROM s)
SELECT listing_id, verdict, CASE WHEN verdict IN ('odometer_recovered', 'odometer_overridden') THEN ocr ELSE said END AS km, CASE WHEN verdict = 'odometer_conflict' THEN 1.25 ELSE 1.0 END::DOUBLE AS widening FROM q""")
def odometer_reconciliation(t):
    reads = cut_lineage(I.odometer_best(I.odometer_candidates(t.tokens)).where("km is not null").select(
        F.floor(F.col("photo_id") / 8).cast("bigint").alias("listing_id"), "km", "conf"))
    vehicles = t.customer.select(F.col("c_custkey").alias("listing_id"), F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") * 37 % 50 * 9000).cast("double")).alias("stated_km"))
    return I.odometer_verdict(reads, vehicles, "listing_id")


@query("f18_vin_from_tokens", oracle="""
v AS (SELECT o_orderkey, upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 17)) AS vin, o_custkey % 3 AS k FROM orders),
w AS (SELECT o_orderkey, vin, k, list_sum([(CASE substr(vin, i, 1) WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 WHEN 'E' THEN 5 WHEN 'F' THEN 6 ELSE CAST(substr(vin, i, 1) AS INTEGER) END)
  * [8,7,6,5,4,3,2,10,0,9,8,7,6,5,4,3,2][i] for i in range(1, 18)]) % 11 AS r FROM v)
SELECT o_orderkey AS photo_id, vin, substr(vin, 9, 1) = CASE CAST(r AS INTEGER) WHEN 10 THEN 'X' ELSE CAST(CAST(r AS INTEGER) AS VARCHAR) END AS check_ok, CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 ELSE 0.7 END::DOUBLE AS conf FROM w""")
def vin_from_tokens(t):
    v = F.upper(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 17))
    k = F.col("o_custkey") % 3
    # One, two or three pieces, lower case, with a label, dashes and other text around them.
    pieces = (F.when(k == 0, F.array(F.concat(F.lit("vin: "), F.lower(v))))
              .when(k == 1, F.array(F.concat(F.lit("VIN#"), F.substring(v, 1, 8)), F.substring(v, 9, 9)))
              .otherwise(F.array(F.substring(v, 1, 5), F.concat(F.substring(v, 6, 3), F.lit("-"), F.substring(v, 9, 3)), F.substring(v, 12, 6))))
    tokens = t.orders.select(F.col("o_orderkey").alias("photo_id"), k.alias("k"), F.posexplode(pieces).alias("pos", "text"))
    conf = F.when(F.col("k") == 0, 0.9).when(F.col("k") == 1, F.when(F.col("pos") == 0, 0.8).otherwise(0.95)).otherwise(F.lit(0.9) - F.col("pos") * 0.1)
    return I.vin_candidates(tokens.withColumn("conf", F.round(conf, 2))).select("photo_id", "vin", "check_ok", "conf")


@query("f18_vin_year_conflict", oracle="""
v AS (SELECT o_orderkey, upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 17)) AS vin, year(o_orderdate) + 20 AS declared FROM orders),
y AS (SELECT *, CASE WHEN substr(vin, 1, 1) IN ('1','2','3','4','5') AND strpos('ABCDEFGHJKLMNPRSTVWXY123456789', substr(vin, 10, 1)) > 0
  THEN CASE WHEN substr(vin, 7, 1) BETWEEN '0' AND '9' THEN 1979 ELSE 2009 END + strpos('ABCDEFGHJKLMNPRSTVWXY123456789', substr(vin, 10, 1)) END AS my FROM v)
SELECT o_orderkey, CASE WHEN my IS NULL THEN 'no_opinion' WHEN abs(my - declared) > 1 THEN 'conflict' ELSE 'agrees' END AS verdict FROM y""")
def vin_year_conflict(t):
    v = F.upper(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 17))
    return t.orders.select("o_orderkey", codes.vin_year_problem(codes.vin_model_year(v), F.year("o_orderdate") + 20).alias("verdict"))


REG_SQL = """
pl AS (SELECT s_suppkey, CAST(s_suppkey * 3 % 1100 AS VARCHAR) AS plate, CASE WHEN s_nationkey % 4 = 0 THEN 'DE' ELSE 'TR' END AS country, s_acctbal AS point FROM supplier),
kn AS (SELECT plate, country, count(*) AS n, min(record_id) AS record_id FROM registry GROUP BY 1, 2),
st AS (SELECT pl.*, kn.record_id AS rid, r.vin, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN r.source = '' THEN 'error' WHEN age_days < 0 OR age_days > 30 THEN 'stale'
  WHEN NOT regexp_full_match(r.vin, '[A-HJ-NPR-Z0-9]{17}') THEN 'error' WHEN NOT commercial THEN 'not_commercial' ELSE 'matched' END AS status
 FROM pl LEFT JOIN kn USING (plate, country) LEFT JOIN registry r ON r.record_id = kn.record_id)"""


def plates(t):
    return t.supplier.select("s_suppkey", (F.col("s_suppkey") * 3 % 1100).cast("string").alias("plate"),
                             F.when(F.col("s_nationkey") % 4 == 0, "DE").otherwise("TR").alias("country"), F.col("s_acctbal").alias("point"))


@query("d13_registry_status", "registry", REG_SQL + " SELECT s_suppkey, plate, country, point, status, CASE WHEN status = 'matched' THEN rid END AS record_id, CASE WHEN status = 'matched' THEN vin END AS vin FROM st")
def registry_status(t):
    return I.registry_status(plates(t), t.registry, t.registry_events)


@query("f20_history_effect", "registry registry_events", REG_SQL + """,
e AS (SELECT record_id, bool_or(type = 'flood' OR (type = 'accident' AND (NOT repaired OR severity = 'unknown'))) AS blk, max(CASE WHEN type = 'accident' AND repaired THEN CASE severity WHEN 'minor' THEN 3 WHEN 'moderate' THEN 8 WHEN 'major' THEN 15 END END) AS pct FROM registry_events GROUP BY 1),
m AS (SELECT *, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN reverse(vin) WHEN 2 THEN lower(vin) ELSE vin END AS photo_vin FROM st WHERE status = 'matched'),
f AS (SELECT m.*, coalesce(upper(photo_vin) = vin, false) AND country = 'TR' AS confirmed, coalesce(blk, false) AS blk, coalesce(pct, 0) AS pct FROM m LEFT JOIN e ON e.record_id = m.rid)
SELECT s_suppkey, confirmed, confirmed AND blk AS blocked, CASE WHEN confirmed AND NOT blk THEN 0.0::DOUBLE - pct ELSE 0.0::DOUBLE END AS adjustment_pct,
 CASE WHEN NOT confirmed THEN round_even(point, 2) WHEN blk THEN 0.0 ELSE round_even(point * (1 - pct / 100), 2) END AS point FROM f""")
def history_effect(t):
    """A photographed VIN is missing, another one, the same in lower case, or the same."""
    matched = I.registry_status(plates(t), t.registry, t.registry_events).where("status = 'matched'")
    k = F.col("s_suppkey") % 4
    seen = F.when(k == 1, F.reverse("vin")).when(k == 2, F.lower("vin")).when(k == 3, F.col("vin"))
    out = I.history_effect(matched.withColumn("photo_vin", seen), t.registry_events, ["point"])
    return out.select("s_suppkey", "confirmed", "blocked", "adjustment_pct", "point")


@query("d14_recalls_and_complaints", "listings", """
r AS (SELECT p_brand, p_type, 2015 + p_size % 7 AS y, count(*) AS recalls, count_if(p_size % 5 = 0) AS severe FROM part GROUP BY 1, 2, 3),
c AS (SELECT o_orderpriority, year(o_orderdate) + 20 AS y, count(*) AS complaints FROM orders GROUP BY 1, 2)
SELECT listing_id, coalesce(recalls, 0) AS recalls, coalesce(severe, 0) AS severe, coalesce(complaints, 0) AS complaints FROM listings l LEFT JOIN r ON r.p_brand = l.make AND r.p_type = l.model AND r.y = l.year
 LEFT JOIN c ON c.o_orderpriority = l.seller_tier AND c.y = l.year""")
def recalls(t):
    r = t.part.groupBy(F.col("p_brand").alias("make"), F.col("p_type").alias("model"), (F.col("p_size") % 7 + 2015).alias("year")).agg(
        F.count("*").alias("recalls"), F.count_if(F.col("p_size") % 5 == 0).alias("severe"))
    c = t.orders.groupBy(F.col("o_orderpriority").alias("seller_tier"), (F.year("o_orderdate") + 20).alias("year")).agg(F.count("*").alias("complaints"))
    j = t.listings.select("listing_id", "make", "model", "year", "seller_tier").join(r, ["make", "model", "year"], "left").join(c, ["seller_tier", "year"], "left")
    return j.select("listing_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("recalls", "severe", "complaints")])


@query("f19_plate_conflicts", oracle="""
o AS (SELECT user_id AS unit, CAST(event_id % 3 AS VARCHAR) AS plate, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 29 = 1 THEN 'DE' ELSE 'TR' END AS country FROM events WHERE value > 60),
b AS (SELECT unit, plate, min(country) AS lo, max(country) AS hi FROM o WHERE country <> '' GROUP BY 1, 2),
f AS (SELECT o.unit, o.plate, CASE WHEN o.country = '' AND lo = hi THEN lo ELSE o.country END AS country FROM o LEFT JOIN b USING (unit, plate)),
c AS (SELECT unit, plate, country, count(*) AS n FROM f WHERE country <> '' GROUP BY 1, 2, 3),
t AS (SELECT unit, max(n) AS top, count(*) AS answers FROM c GROUP BY 1), l AS (SELECT unit, top, answers, count_if(n = top) AS leaders, max(CASE WHEN n = top THEN plate END) AS plate, max(CASE WHEN n = top THEN country END) AS country FROM t JOIN c USING (unit) GROUP BY 1, 2, 3)
SELECT unit, CASE WHEN won THEN plate END AS plate, CASE WHEN won THEN country END AS country, NOT won AS conflict FROM (SELECT *, answers = 1 OR (leaders = 1 AND top >= 2) AS won FROM l)""")
def plate_conflicts(t):
    country = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 29 == 1, "DE").otherwise("TR")
    obs = t.events.select(F.col("user_id").alias("unit"), (F.col("event_id") % 3).cast("string").alias("plate"), country.alias("country"),
                          F.when(F.col("value") > 60, 0.97).otherwise(0.6).alias("confidence"))
    return I.plate_winner(obs, UNIT)


@query("f21_detail_downgrade", "findings", """
SELECT listing_id, photo_id, confidence AS before, CASE WHEN hit AND low < confidence THEN low ELSE confidence END AS after, hit AND coalesce(low < confidence, false) AS corrected FROM (
 SELECT *, photo_id % 3 = 0 AND regexp_matches(observation, '(?i)\\b(that|the|die|une)\\b') AS hit, round(greatest(0.2, confidence * (1 - 0.6::DOUBLE)), 3) AS low FROM findings)""")
def detail_downgrade(t):
    photos = t.findings.select("listing_id", "photo_id", (F.col("photo_id") % 3 != 0).alias("fine_detail_ok"), F.lit(0.6).alias("degradation")).distinct()
    out = I.detail_downgrade(t.findings, photos, r"(?i)\b(that|the|die|une)\b")
    return out.withColumn("corrected", F.coalesce("corrected", F.lit(False)))


# ---- set-level gate ----

GATE_SQL = f"""
c AS (SELECT *, NOT (blur < 34 OR brightness < 0.0824 OR brightness > 0.7514 OR dark_frac > 0.6384 OR bright_frac > 0.1727 OR contrast < 0.0858) AS usable, doc_id % 3 = 0 AS truck, doc_id % 97 = 5 AS other,
  CASE doc_id % 4 WHEN 0 THEN 'tractor' WHEN 1 THEN 'rigid' WHEN 2 THEN 'unknown' END AS tag, round((doc_id % 50) / 100.0::DOUBLE + 0.4, 2) AS tag_conf FROM photos),
g AS (SELECT source_key, listing_id, count_if(usable) AS u, count_if(truck) AS tr, count_if(other) AS oth, count_if(usable AND view IN ('exterior_front_34','exterior_side','exterior_front','exterior_rear')) AS wh,
  count_if(usable AND view_conf >= 0.5 AND content_label = 'keep' AND view IN ('tire_wheel','interior_cab','dashboard_odometer','engine_bay','chassis_undercarriage','fifth_wheel')) AS parts, list(DISTINCT view) FILTER (WHERE usable) AS vs FROM c GROUP BY 1, 2),
gate AS (SELECT *, [v for v in ['exterior_front_34','tire_wheel','dashboard_odometer'] if NOT coalesce(list_contains(vs, v), false)] AS missing FROM g)"""


def gate_photos(t):
    from ..functions.photos import capture_reasons, usable
    c = F.col
    ok = usable(capture_reasons(c("blur"), c("brightness"), c("contrast"), c("dark_frac"), c("bright_frac")))
    tag = F.when(c("doc_id") % 4 == 0, "tractor").when(c("doc_id") % 4 == 1, "rigid").when(c("doc_id") % 4 == 2, "unknown")
    return t.photos.withColumns({"usable": ok, "truck": c("doc_id") % 3 == 0, "other_subject": c("doc_id") % 97 == 5, "photo_seq": c("doc_id"),
                                 "body_tag": tag, "body_tag_conf": F.round(c("doc_id") % 50 / 100 + 0.4, 2)})


@query("e09_gate_decision", "photos", GATE_SQL + """
SELECT source_key, listing_id, array_to_string(missing, ',') AS missing, CASE WHEN u = 0 THEN 'refuse_quality' WHEN tr = 0 AND (oth > 0 OR parts < greatest(1, (u + 1) // 2)) THEN 'refuse_not_a_truck'
 WHEN tr = 0 OR wh = 0 THEN 'ask_more_whole_vehicle' WHEN u < 3 THEN 'ask_more_photos' WHEN len(missing) > 0 THEN 'ask_more_views' ELSE 'pass' END AS decision FROM gate""")
def gate_decision(t):
    return G.decide(gate_photos(t), K.VEHICLE).select(*K.VEHICLE, F.array_join("missing", ",").alias("missing"), "decision")


TAG_SQL = """,
tg AS (SELECT source_key, listing_id, tag, count(*) AS n, min(doc_id) AS seq, list_sort(list(tag_conf)) AS l FROM c WHERE usable AND tag IS NOT NULL AND tag <> 'unknown' AND view IN ('exterior_front_34','exterior_side','exterior_front','exterior_rear') GROUP BY 1, 2, 3),
tb AS (SELECT source_key, listing_id, arg_max(tag, {'n': n, 's': -seq}) AS body_tag, arg_max(l[len(l) // 2 + 1], {'n': n, 's': -seq}) AS body_tag_conf FROM tg GROUP BY 1, 2)"""


@query("e09_pooled_body_tag", "photos", GATE_SQL + TAG_SQL + " SELECT source_key, listing_id, body_tag, round(body_tag_conf, 3) AS body_tag_conf FROM tb")
def pooled_body_tag(t):
    return G.body_tag(gate_photos(t), K.VEHICLE)


@query("e10_pricing_blockers", "photos", GATE_SQL + TAG_SQL + """
SELECT source_key, listing_id, CASE WHEN wh % 4 >= 3 THEN 'several_vehicles' WHEN tr % 3 = 0 AND body_tag = 'rigid' AND body_tag_conf >= 0.6 THEN 'rigid_tag' WHEN oth > 0 THEN 'not_one_vehicle'
 WHEN tr % 3 = 1 THEN 'body_type' END AS blocker FROM gate LEFT JOIN tb USING (source_key, listing_id)""")
def pricing_blockers(t):
    p = cut_lineage(gate_photos(t))
    g = G.decide(p, K.VEHICLE).join(G.body_tag(p, K.VEHICLE), K.VEHICLE, "left")
    body = F.when(F.col("trucks") % 3 == 0, "").when(F.col("trucks") % 3 == 1, "Rigid_Truck").otherwise("tractor_unit")
    blocker = G.pricing_blocker(F.col("wholes") % 4, 3, F.col("body_tag"), F.col("body_tag_conf"), 0.6, body, F.lit(0.7), F.col("others") == 0)
    return g.select(*K.VEHICLE, blocker.alias("blocker"))


@query("e11_cluster_count_threshold", "photos", """
n AS (SELECT source_key, listing_id, count(DISTINCT view) AS k FROM photos GROUP BY 1, 2),
h AS (SELECT k, count(*) AS n FROM n GROUP BY 1),
s AS (SELECT k, n, sum(n) OVER (ORDER BY k DESC) AS at_least, sum(n) OVER () AS total FROM h)
SELECT k, n, at_least, round(at_least / total, 6) AS tail_share, greatest(2, coalesce((SELECT max(k) FROM s WHERE at_least / total > 0.05), 1) + 1) AS threshold FROM s""")
def cluster_count_threshold(t):
    counts = t.photos.groupBy(*K.VEHICLE).agg(F.count_distinct("view").alias("k"))
    out = G.cluster_threshold(counts, "k", 0.05)
    return out.select("k", "n", "at_least", F.round("tail_share", 6).alias("tail_share"), "threshold")


@query("e12_rigid_tag_confidence", "photos", GATE_SQL + TAG_SQL + """
SELECT count_if(body_tag = 'rigid') AS rigid_n, round(max(CASE WHEN body_tag = 'rigid' THEN body_tag_conf END), 3) AS max_conf,
 CASE WHEN 0.93 >= round(coalesce(max(CASE WHEN body_tag = 'rigid' THEN body_tag_conf END), 0.54) + 0.01, 2) THEN round(greatest(0.55, coalesce(max(CASE WHEN body_tag = 'rigid' THEN body_tag_conf END), 0.54) + 0.01), 2) END AS block_conf FROM tb""")
def rigid_tag_confidence(t):
    tags = G.body_tag(gate_photos(t), K.VEHICLE)
    top = F.max(F.when(F.col("body_tag") == "rigid", F.col("body_tag_conf")))
    floor = F.round(F.coalesce(top, F.lit(0.54)) + 0.01, 2)
    return tags.agg(F.count_if(F.col("body_tag") == "rigid").alias("rigid_n"), F.round(top, 3).alias("max_conf"),
                    F.when(F.lit(0.93) >= floor, F.round(F.greatest(F.lit(0.55), floor), 2)).alias("block_conf"))


@query("d21_view_sets", "photos", GATE_SQL + """,
h AS (SELECT source_key, listing_id, list(DISTINCT view) FILTER (WHERE view_conf >= 0.8) AS sure FROM photos GROUP BY 1, 2),
r AS (SELECT g.*, [v for v in missing if coalesce(list_contains(sure, v), false)] AS restored FROM gate g JOIN h USING (source_key, listing_id))
SELECT source_key, listing_id, array_to_string(restored, ',') AS restored, array_to_string([v for v in missing if NOT list_contains(restored, v)], ',') AS still_missing,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(vs, []), restored))), ',') AS views_after FROM r""")
def view_sets(t):
    p = gate_photos(t)
    sure = p.groupBy(*K.VEHICLE).agg(F.collect_set(F.when(F.col("view_conf") >= 0.8, F.col("view"))).alias("sure"))
    g = G.decide(p, K.VEHICLE).join(sure, K.VEHICLE)
    out = g.select(*K.VEHICLE, *[c.alias(n) for n, c in G.view_changes(F.col("views"), F.col("missing"), F.col("sure")).items()])
    return out.select(*K.VEHICLE, *[F.array_join(c, ",").alias(c) for c in ("restored", "still_missing", "views_after")])
