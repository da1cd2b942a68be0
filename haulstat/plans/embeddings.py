"""Embedding, detector and probe queries."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import listings as L
from ..functions.draws import fold_of, hash32, uniform
from ..operators import boxes as B
from ..operators import clusters as C
from ..operators import heads as D
from ..operators import permutations as M
from ..operators import ranking as R
from ..operators import regression as G
from ..operators import sampling as S
from ..operators import vectors as V
from ..session import cut_lineage
from .pricing import DENSE, SHIFTS, by_key, frame, permuted_column, spec_residuals
from .registry import query
from .statements import ridge_sql

EMB_SQL = """
e AS (SELECT vec_id, label, list_transform_d AS v, substr(md5(CAST(vec_id // 2 AS VARCHAR)), 1, 16) AS h FROM (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS list_transform_d FROM embeddings))"""


def emb(t):
    code = F.md5(F.floor(F.col("vec_id") / 2).cast("string"))
    half = lambda at: F.conv(F.substring(code, at, 8), 16, 10).cast("bigint")
    return t.embeddings.withColumn("code", F.shiftleft(half(1), 32).bitwiseOR(half(9)))


@query("d08_same_group_retrieval", oracle=EMB_SQL + """,
p AS (SELECT a.vec_id, a.label, b.vec_id AS n, b.label AS nl, round(list_dot_product(a.v, b.v), 12) AS s, a.h = b.h AS near FROM e a JOIN e b ON a.vec_id <> b.vec_id),
b AS (SELECT vec_id, arg_max(label, 1) AS label, arg_max(nl, {'s': s, 'n': -n}) AS hit, arg_max(nl, {'s': CASE WHEN near AND label = nl THEN -2 ELSE s END, 'n': -n}) AS hard FROM p GROUP BY 1)
SELECT count(*) AS n, round(avg(CAST(label = hit AS INTEGER)), 4) AS p_at_1, round(avg(CAST(label = hard AS INTEGER)), 4) AS p_at_1_hardened FROM b""")
def retrieval(t):
    base = cut_lineage(emb(t))
    label = base.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("hit"))
    best = cut_lineage(V.nearest_cosine(base, "vec_id", "embedding", "label", "code"))
    plain = best.join(label, "neighbour")
    hard = best.select("vec_id", "label", F.col("far_neighbour").alias("neighbour")).join(label, "neighbour")
    share = lambda df, n: df.agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("hit")).cast("int")), 4).alias(n))
    return R.with_row(share(plain, "p_at_1"), share(hard, "p_at_1_hardened").drop("n"), "p_at_1_hardened")


@query("d09_group_consistency", oracle=EMB_SQL + """
SELECT a.label, round(avg(list_dot_product(a.v, b.v)), 4) AS consistency, count(DISTINCT a.vec_id) + 1 AS m FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def group_consistency(t):
    out = V.consistency(t.embeddings, "label", "embedding", 20)
    return out.select("label", F.round("inside", 4).alias("consistency"), "m")


@query("d09_foil_separation")
def foil_separation(t):
    out = V.consistency(t.embeddings, "label", "embedding", 20)
    return out.agg(F.count("*").alias("groups"), F.round(F.avg("inside"), 4).alias("consistency"), F.round(F.avg("separation"), 4).alias("separation"))


@query("d10_appearance_clusters", oracle="WITH_RECURSIVE" + EMB_SQL + """,
p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.3),
r AS (SELECT label, vec_id AS id, vec_id AS root FROM e UNION SELECT r.label, p.b, r.root FROM r JOIN p ON p.label = r.label AND p.a = r.id),
c AS (SELECT label, id, min(root) AS component FROM r GROUP BY 1, 2)
SELECT label, count(DISTINCT component) AS clusters, count(*) AS items FROM c GROUP BY 1""")
def appearance_clusters(t):
    rows = cut_lineage(t.embeddings.select("label", "vec_id", "embedding"))
    pairs = cut_lineage(V.close_pairs(rows, ["label"], "vec_id", "embedding", 0.3))
    comp = C.components(rows.select("label", F.col("vec_id").alias("id")), pairs.select("label", "a", "b"), ["label"])
    return comp.groupBy("label").agg(F.count_distinct("component").alias("clusters"), F.count("*").alias("items"))


BANK_SQL = EMB_SQL + """,
bk AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS x FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1)"""


def bank(t):
    s = V.group_sums(t.embeddings, ["label"], "embedding")
    return s.select("label", F.transform("total", lambda x: x / F.col("m")).alias("vector"))


@query("d19_zero_shot_tag", oracle=BANK_SQL + """,
s AS (SELECT vec_id, bk.label, 25 * list_dot_product(e.v, bk.c) AS z FROM e, bk),
m AS (SELECT vec_id, max(z) AS top, arg_max(label, {'z': round(z, 9), 'l': -label}) AS tag FROM s GROUP BY 1)
SELECT vec_id, CAST(tag AS VARCHAR) AS tag, round(1 / sum(exp(z - top)), 4) AS tag_confidence FROM s JOIN m USING (vec_id) GROUP BY vec_id, tag""")
def zero_shot_tag(t):
    return V.zero_shot(t.embeddings, "embedding", bank(t), 25.0).select("vec_id", "tag", F.round("tag_confidence", 4).alias("tag_confidence"))


@query("c05_content_gate", oracle=BANK_SQL + """,
s AS (SELECT vec_id, bk.label, list_dot_product(e.v, bk.c) AS z FROM e, bk), m AS (SELECT vec_id, arg_max(label, {'z': round(z, 9), 'l': -label}) AS tag FROM s GROUP BY 1)
SELECT CASE WHEN tag >= 7 THEN 'drop_content_' || CAST(tag AS VARCHAR) ELSE 'kept' END AS outcome, count(*) AS n FROM m GROUP BY 1""")
def content_gate(t):
    tagged = V.zero_shot(t.embeddings, "embedding", bank(t), 25.0)
    outcome = F.when(F.col("tag").cast("int") >= 7, F.concat(F.lit("drop_content_"), "tag")).otherwise("kept")
    return tagged.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


PROTO_SQL = EMB_SQL + """,
x AS (SELECT *, 0.5 + (vec_id % 10) / 20.0::DOUBLE AS w FROM e), ix AS (SELECT unnest(range(1, 65)) AS i),
p1 AS (SELECT label, list(s ORDER BY i) AS c FROM (SELECT label, i, sum(v[i] * w) AS s FROM x, ix GROUP BY 1, 2) GROUP BY 1),
q1 AS (SELECT label, [y / sqrt(list_dot_product(c, c)) for y in c] AS c FROM p1),
s1 AS (SELECT x.*, list_dot_product(x.v, q1.c) AS sim FROM x JOIN q1 USING (label)),
f1 AS (SELECT label, avg(sim) - 2 * stddev_pop(sim) AS fl, count(*) AS n FROM s1 GROUP BY 1),
k AS (SELECT s1.* FROM s1 JOIN f1 USING (label) WHERE n < 3 OR sim >= fl),
p2 AS (SELECT label, list(s ORDER BY i) AS c FROM (SELECT label, i, sum(v[i] * w) AS s FROM k, ix GROUP BY 1, 2) GROUP BY 1),
proto AS (SELECT label, [y / sqrt(list_dot_product(c, c)) for y in c] AS c, (SELECT count(*) FROM k WHERE k.label = p2.label) AS n_kept, (SELECT n FROM f1 WHERE f1.label = p2.label) AS n_seeds FROM p2)"""


def seeds(t):
    return t.embeddings.withColumn("w", 0.5 + F.col("vec_id") % 10 / 20)


@query("e15_prototypes", oracle=PROTO_SQL + " SELECT label, n_seeds, n_kept, round(c[1], 4) AS p1, round(c[32], 4) AS p32, round(c[64], 4) AS p64 FROM proto")
def prototypes(t):
    p = V.prototypes(seeds(t), "label", "embedding", "w")
    at = lambda i: F.round(F.element_at("prototype", i), 4).alias(f"p{i}")
    return p.select("label", "n_seeds", "n_kept", at(1), at(32), at(64))


@query("e15_frame_contrast", oracle=PROTO_SQL + """,
s AS (SELECT vec_id, vec_id // 5 AS fr, list_dot_product(e.v, proto.c) AS s FROM e JOIN proto USING (label))
SELECT vec_id, round(CASE WHEN max(s) OVER w - min(s) OVER w > 1e-9 THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 1 END, 4) AS contrast FROM s WINDOW w AS (PARTITION BY fr)""")
def frame_contrast(t):
    p = V.prototypes(seeds(t), "label", "embedding", "w")
    scored = t.embeddings.join(p.select("label", "prototype"), "label").select(
        "vec_id", F.floor(F.col("vec_id") / 5).alias("frame"), V.dot(F.col("embedding"), F.col("prototype")).alias("s"))
    return V.frame_contrast(scored, ["frame"], "s").select("vec_id", F.round("contrast", 4).alias("contrast"))


@query("e14_foil_calibration", oracle=PROTO_SQL + """,
s AS (SELECT e.label, list_dot_product(e.v, a.c) AS own, list_dot_product(e.v, b.c) AS foil FROM e JOIN proto a ON a.label = e.label JOIN proto b ON b.label = (e.label + 1 + ('0x' || substr(md5('11|' || CAST(e.label AS VARCHAR)), 1, 8))::BIGINT % 9) % 10),
c AS (SELECT quantile_cont(foil, 0.95) AS cut FROM s)
SELECT round(cut, 4) AS threshold, round(avg(CAST(own >= cut AS INTEGER)), 4) AS recall, round(avg(CAST(own >= cut AS INTEGER)), 4) >= 0.25 AND cut < 0.999 AS separable FROM s, c GROUP BY cut""")
def foil_calibration(t):
    p = cut_lineage(V.prototypes(seeds(t), "label", "embedding", "w").select("label", "prototype"))
    jump = F.pmod(hash32(F.concat(F.lit("11|"), F.col("label").cast("string"))), F.lit(9))
    rows = t.embeddings.withColumn("foil", F.pmod(F.col("label") + 1 + jump, F.lit(10)).cast("int"))
    both = rows.join(p, "label").join(p.select(F.col("label").alias("foil"), F.col("prototype").alias("other")), "foil")
    s = cut_lineage(both.select(V.dot(F.col("embedding"), F.col("prototype")).alias("own"), V.dot(F.col("embedding"), F.col("other")).alias("foil")))
    cut = R.exact_percentiles(s, [], "foil", [0.95], ["cut"])
    out = R.with_row(s, cut, "cut").agg(F.first("cut").alias("cut"), F.round(F.avg((F.col("own") >= F.col("cut")).cast("int")), 4).alias("recall"))
    return out.select(F.round("cut", 4).alias("threshold"), "recall", ((F.col("recall") >= 0.25) & (F.col("cut") < 0.999)).alias("separable"))


# ---- boxes ----

IOU_SQL = """CASE WHEN greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) <= 0 THEN 0 ELSE
 greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
 - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) END"""


@query("b19_box_overlap", "boxes", f"""
SELECT a.photo_id, a.box_id, b.box_id AS later_box, round({IOU_SQL}, 4) AS iou FROM boxes a JOIN boxes b ON a.photo_id = b.photo_id AND {IOU_SQL} >= 0.7
 AND a.label IN ('truck','bus','car') AND b.label IN ('truck','bus','car') AND (a.confidence > b.confidence OR (a.confidence = b.confidence AND a.box_id < b.box_id))""")
def box_overlap(t):
    boxes = t.boxes
    pairs = B.same_box_pairs(boxes)
    a, b = boxes.alias("a"), boxes.alias("b")
    j = pairs.join(a, (pairs.photo_id == F.col("a.photo_id")) & (pairs.box_id == F.col("a.box_id"))).join(b, (pairs.photo_id == F.col("b.photo_id")) & (pairs.later_box == F.col("b.box_id")))
    return j.select(pairs.photo_id, pairs.box_id, pairs.later_box, F.round(B.box_iou("a", "b"), 4).alias("iou"))


@query("d11_vehicle_box_dedupe", "boxes", "WITH_RECURSIVE" + """
o AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY confidence DESC, box_id) AS r FROM boxes WHERE label IN ('truck','bus','car')),
rec AS (SELECT DISTINCT photo_id, 0::BIGINT AS r, 0::BIGINT AS box_id, false AS keep, [{'x1': 0.0::DOUBLE, 'y1': 0.0::DOUBLE, 'x2': 0.0::DOUBLE, 'y2': 0.0::DOUBLE}][1:0] AS k FROM o
 UNION ALL SELECT photo_id, r, box_id, NOT hit, CASE WHEN hit THEN k ELSE list_append(k, {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) END FROM (
  SELECT a.photo_id, a.r, a.box_id, a.x1, a.y1, a.x2, a.y2, q.k, len([b for b in q.k if """ + IOU_SQL + """ >= 0.7]) > 0 AS hit FROM rec q JOIN o a ON a.photo_id = q.photo_id AND a.r = q.r + 1))
SELECT photo_id, box_id FROM rec WHERE keep UNION ALL SELECT photo_id, box_id FROM boxes WHERE label NOT IN ('truck','bus','car')""")
def vehicle_box_dedupe(t):
    return B.dedupe_vehicles(t.boxes)


DOM_SQL = """
g AS (SELECT listing_id, photo_id, max(CASE WHEN label IN ('truck','bus') THEN {'c': confidence, 'a': area_frac} END) AS b, coalesce(max(CASE WHEN label NOT IN ('truck','bus') AND confidence >= 0.5 THEN area_frac END), 0) AS rival FROM boxes GROUP BY 1, 2),
d AS (SELECT listing_id, photo_id, CASE WHEN coalesce(b.a >= 0.12 AND b.a >= rival, false) THEN b.c ELSE 0 END AS best FROM g)"""


@query("e04_detector_operating_point", "boxes", DOM_SQL + f""",
v AS (SELECT listing_id, max(best) AS m FROM d GROUP BY 1), pr AS (SELECT count(*) AS n FROM boxes a JOIN boxes b ON a.photo_id = b.photo_id AND a.box_id < b.box_id AND a.label IN ('truck','bus','car') AND b.label IN ('truck','bus','car') AND {IOU_SQL} >= 0.7)
SELECT (SELECT count(*) FROM d) AS photos, (SELECT round(avg(CAST(best >= 0.25 AS INTEGER)), 4) FROM d) AS photo_share_25, (SELECT round(avg(CAST(best >= 0.5 AS INTEGER)), 4) FROM d) AS photo_share_50, count(*) AS vehicles, count_if(m < 0.25) AS vehicles_without_25,
 round(quantile_cont(m, 0.05), 4) AS conf_q05, round((SELECT n FROM pr) / (SELECT count(*) FROM d), 4) AS duplicates_per_frame FROM v""")
def operating_point(t):
    d = cut_lineage(B.dominant(t.boxes, ["listing_id"]))
    v = cut_lineage(d.groupBy("listing_id").agg(F.max("best").alias("m")))
    photos = d.agg(F.count("*").alias("photos"), F.round(F.avg((F.col("best") >= 0.25).cast("int")), 4).alias("photo_share_25"), F.round(F.avg((F.col("best") >= 0.5).cast("int")), 4).alias("photo_share_50"))
    cars = v.agg(F.count("*").alias("vehicles"), F.count_if(F.col("m") < 0.25).alias("vehicles_without_25"))
    dup = B.same_box_pairs(t.boxes).agg(F.count("*").alias("pairs"))
    low = R.exact_percentiles(v, [], "m", [0.05], ["q05"])
    out = R.with_row(R.with_row(R.with_row(photos, cars, "vehicles", "vehicles_without_25"), dup, "pairs"), low, "q05")
    return out.select("photos", "photo_share_25", "photo_share_50", "vehicles", "vehicles_without_25", F.round("q05", 4).alias("conf_q05"), F.round(F.col("pairs") / F.col("photos"), 4).alias("duplicates_per_frame"))


SCORE_SQL = """
geo AS (SELECT *, least(1.0, sqrt(((x1 + x2) / 2 / 1000 - 0.5) ** 2 + ((y1 + y2) / 2 / 800 - 0.5) ** 2) / (0.5::DOUBLE * 2::DOUBLE ** 0.5)) AS far, 500 BETWEEN x1 AND x2 AND 400 BETWEEN y1 AND y2 AS hit,
  CAST(x1 <= 2 AS INTEGER) + CAST(y1 <= 2 AS INTEGER) + CAST(x2 >= 998 AS INTEGER) + CAST(y2 >= 798 AS INTEGER) AS cl, photo_id % 4 = 1 AS close_up, 0.4 + (box_id % 10) / 10.0::DOUBLE AS focus, (box_id % 7) / 6.0::DOUBLE AS sim FROM boxes),
sc AS (SELECT *, CASE label WHEN 'truck' THEN 1.0 WHEN 'bus' THEN 0.92 WHEN 'car' THEN 0.55 ELSE 0 END::DOUBLE * (0.4 + 0.6 * confidence) * sqrt(area_frac) * CASE WHEN hit THEN 1.35 ELSE 1 - 0.55 * far END * CASE WHEN hit THEN 1 + 0.18 * cl ELSE 1 END AS g0,
  label IN ('truck','bus','car') AND NOT (area_frac < 0.04 OR (focus < 0.55 AND area_frac < 0.9464) OR (close_up AND area_frac < 0.9464)) AND (label <> 'car' OR NOT bool_or(label IN ('truck','bus')) OVER (PARTITION BY photo_id)) AS ok FROM geo)"""


def scored_boxes(t):
    return B.with_geometry(t.boxes, 1000.0, 800.0).withColumns({
        "close_up": F.col("photo_id") % 4 == 1, "focus_ratio": 0.4 + F.col("box_id") % 10 / 10, "sim": F.col("box_id") % 7 / 6})


@query("b20_frame_score", "boxes", SCORE_SQL + " SELECT photo_id, box_id, round(g0, 4) AS score, ok AS eligible FROM sc")
def frame_score(t):
    boxes = scored_boxes(t)
    flags = boxes.groupBy("photo_id").agg(F.bool_or(F.col("label").isin("truck", "bus")).alias("has_truck"))
    return boxes.join(flags, "photo_id").select("photo_id", "box_id", F.round(B.frame_score(), 4).alias("score"), B.eligible(F.col("close_up")).alias("eligible"))


PICK_SQL = SCORE_SQL + """,
k AS (SELECT *, round(g0, 9) AS gs, round(g0 * (0.3 + 0.7 * sim), 9) AS fs FROM sc WHERE ok),
b AS (SELECT listing_id, photo_id, max({'s': fs, 'i': -box_id, 'h': hit, 'a': area_frac}) AS f, max({'s': gs, 'i': -box_id, 'h': hit, 'a': area_frac}) AS g FROM k GROUP BY 1, 2),
p AS (SELECT listing_id, photo_id, CASE WHEN f.i <> g.i AND g.h AND NOT f.h THEN -g.i ELSE -f.i END AS subject, CASE WHEN f.i <> g.i AND g.h AND NOT f.h THEN g.a ELSE f.a END AS area, f.i <> g.i AND g.h AND NOT f.h AS kept_framing FROM b),
pick AS (SELECT p.*, (SELECT count(*) FROM boxes x WHERE x.photo_id = p.photo_id AND x.box_id <> p.subject AND x.confidence >= 0.4 AND x.area_frac >= greatest(0.02, 0.08 * p.area)) AS competing FROM p)"""


@query("e16_subject_selection", "boxes", PICK_SQL + " SELECT photo_id, subject, kept_framing, competing FROM pick")
def subject_selection(t):
    return B.choose_subject(scored_boxes(t), ["listing_id"], F.col("sim")).select("photo_id", "subject", "kept_framing", "competing")


@query("e17_selection_rates", "boxes", PICK_SQL + """,
f AS (SELECT DISTINCT listing_id, photo_id, photo_id % 4 = 1 AS part FROM boxes)
SELECT count(*) AS frames, round(count_if(part AND subject IS NOT NULL) / count_if(part), 4) AS part_subject_rate, round(count_if(NOT part AND subject IS NULL) / count_if(NOT part), 4) AS whole_miss_rate,
 round(avg(CAST((subject IS NOT NULL) = NOT part AS INTEGER)), 4) AS view_agreement, (SELECT count(*) FROM (SELECT f.listing_id FROM f LEFT JOIN pick p USING (photo_id) GROUP BY 1 HAVING count(p.subject) = 0)) AS vehicles_without_subject FROM f LEFT JOIN pick p USING (photo_id)""")
def selection_rates(t):
    picked = B.choose_subject(scored_boxes(t), ["listing_id"], F.col("sim")).select("photo_id", "subject")
    frames = cut_lineage(t.boxes.select("listing_id", "photo_id").distinct().join(picked, "photo_id", "left").withColumn("part", F.col("photo_id") % 4 == 1))
    has = F.col("subject").isNotNull()
    part = F.col("part")
    out = frames.agg(F.count("*").alias("frames"), F.round(F.count_if(part & has) / F.count_if(part), 4).alias("part_subject_rate"),
                     F.round(F.count_if(~part & ~has) / F.count_if(~part), 4).alias("whole_miss_rate"), F.round(F.avg((has == ~part).cast("int")), 4).alias("view_agreement"))
    none = frames.groupBy("listing_id").agg(F.count("subject").alias("k")).agg(F.count_if(F.col("k") == 0).alias("vehicles_without_subject"))
    return R.with_row(out, none, "vehicles_without_subject")


@query("e18_arm_shortlist", "boxes", """
a AS (SELECT CAST(CAST(substr(listing_id, length(listing_id), 1) AS INTEGER) AS VARCHAR) AS arm, avg(confidence) AS conf, avg(CAST(label = 'truck' AS INTEGER)) AS hit, count(*) AS n FROM boxes GROUP BY 1),
i AS (SELECT * FROM a WHERE arm = '0'), d AS (SELECT arm FROM a WHERE n % 7 = 0),
k AS (SELECT a.arm, a.conf, a.hit FROM a, i WHERE a.arm <> '0' AND a.conf >= i.conf * 0.98 AND a.arm NOT IN (SELECT arm FROM d))
SELECT arm, round(conf, 4) AS conf, round(hit, 4) AS hit FROM k ORDER BY hit DESC, arm LIMIT 3""")
def arm_shortlist(t):
    a = cut_lineage(t.boxes.groupBy(F.substring("listing_id", -1, 1).alias("arm")).agg(F.avg("confidence").alias("conf"), F.avg((F.col("label") == "truck").cast("int")).alias("hit"), F.count("*").alias("n")))
    incumbent = a.where("arm = '0'").agg(F.max("conf").alias("base"))
    done = a.where("n % 7 = 0").select("arm")
    ok = R.with_row(a.where("arm <> '0'"), incumbent, "base").where("conf >= base * 0.98").join(done, "arm", "left_anti")
    return ok.orderBy(F.desc("hit"), "arm").limit(3).select("arm", F.round("conf", 4).alias("conf"), F.round("hit", 4).alias("hit"))


# ---- probes and heads ----

PROBE_DRAWS, LEAST_VEHICLES = 60, 12
POOLS = {"TR": ("TR",), "US": ("US",), "pooled": ("TR", "US")}


def vehicle_embeddings(t):
    """(vehicle, e0, e1, ...): the mean of a vehicle's photo vectors, of length one. Two photos in a row show one vehicle."""
    width = t.embeddings.agg(F.max(F.size("embedding")).alias("d")).first()["d"] or 0
    names = [f"e{i}" for i in range(width)]
    photos = t.embeddings.select(F.floor(F.col("vec_id") / 2).cast("string").alias("vehicle"), *[F.get("embedding", i).cast("double").alias(c) for i, c in enumerate(names)])
    means = photos.groupBy("vehicle").agg(*[F.avg(c).alias(c) for c in names])
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0))) + 1e-9
    return means.withColumn("_length", length).select("vehicle", *[(F.col(c) / F.col("_length")).alias(c) for c in names]), names


def probe_nulls(df, xs, dims, draws=PROBE_DRAWS, seed="residual"):
    """Nested R2 of ``y`` on ``xs``, and of ``y`` permuted between the vehicles of a fold, ``draws`` times.

    ``df`` has vehicle, fold, y and the columns xs. The columns' products with each other are summed once; a
    permuted target needs only its own products with them, added up where the vehicles are.
    """
    d = len(xs)
    cells = {}
    for (fold,), m in V.gram_cells(df.withColumn("_xs", F.array(*[F.col(c) for c in xs])), ["fold"], "_xs", ["y"]).items():
        big = np.zeros((d + 2 + draws, d + 2 + draws))
        big[:d + 2, :d + 2] = m
        cells[fold] = big
    place = {"1": 0, **{c: i + 1 for i, c in enumerate(xs)}}
    for r in M.permuted_sums(df, "y", xs, "vehicle", draws, seed, strata=["fold"], by=["fold"]).where("draw > 0").toLocalIterator():
        at = d + 1 + r.draw
        i = at if r.term == "1^2" else place[r.term]
        cells[r.fold][i, at] = cells[r.fold][at, i] = r.value
    scores = V.nested_probe(cells, d, 1 + draws, dims=dims)
    return float(scores[0]), scores[1:]


def probe_row(name, df, xs, dims, extra=()):
    """One line of a probe's table; fewer than ``LEAST_VEHICLES`` vehicles, or fewer than three folds with any, are not asked."""
    df = cut_lineage(df.withColumn("fold", fold_of(F.col("vehicle"), 5)))
    n, folds, sd = df.agg(F.count("*"), F.countDistinct("fold"), F.stddev_pop("y")).first()
    if n < LEAST_VEHICLES or folds < 3:
        return (name, n, *extra, None, None, None, None, 0, None, "skipped")
    real, null = probe_nulls(df, xs, dims)
    p = float(np.mean(null >= real))
    return (name, n, *extra, float(sd), real, float(np.median(null)), float(np.percentile(null, 95)), len(null), p, "signal" if p < 0.05 else "no_signal")


def pooled_frame(t):
    """The price frame of all pools, stored once: each pool reads it twice."""
    markets = sorted({m for pool in POOLS.values() for m in pool})
    return cut_lineage(frame(t).where(F.col("market").isin(*markets)).select("listing_id", "market", "brand", "fold", *DENSE, "y"))


def pool_residuals(adverts, markets):
    """(vehicle, y): the mean out-of-fold residual of a vehicle's adverts, fitted on these markets alone."""
    return spec_residuals(adverts.where(F.col("market").isin(*markets))).groupBy("vehicle").agg(F.avg("resid").alias("y"))


@query("i13_residual_signal_probe")
def residual_signal_probe(t):
    """Do the embeddings explain what the price model leaves? By market and pooled, nested folds against permuted residuals."""
    vectors, xs = vehicle_embeddings(t)
    vectors, adverts = cut_lineage(vectors), pooled_frame(t)
    rows = [probe_row(name, pool_residuals(adverts, markets).join(vectors, "vehicle"), xs, (4, 8, 16, 32)) for name, markets in POOLS.items()]
    return t.spark.createDataFrame(rows, """pool string, n_vehicles bigint, residual_sd double, r2 double, null_median double, null_p95 double, draws bigint,
        p_value double, verdict string""")


def panel_features(t):
    """(vehicle, panel_score, one column for each rater's mean level): a rater without a reading of a vehicle counts as 0."""
    raters = sorted(r["rater"] for r in t.ratings.where("rater is not null").select("rater").distinct().collect())  # a panel
    share = F.col("level") / 3.0
    each = [F.coalesce(F.avg(F.when(F.col("rater") == r, share)), F.lit(0.0)).alias(f"rater_{i}") for i, r in enumerate(raters)]
    return t.ratings.groupBy("vehicle").agg(F.avg(share).alias("panel_score"), *each), ["panel_score", *[f"rater_{i}" for i in range(len(raters))]]


@query("i14_panel_score_probe")
def panel_score_probe(t):
    """Do panel scores explain what the price model leaves, where they spread at all? The same pools and null; alpha alone is chosen."""
    features, xs = panel_features(t)
    features, adverts = cut_lineage(features), pooled_frame(t)
    rows = []
    for name, markets in POOLS.items():
        df = cut_lineage(pool_residuals(adverts, markets).join(features, "vehicle"))
        spread = df.agg(F.stddev_samp("panel_score").alias("sd"), F.countDistinct("panel_score").alias("n")).first()
        row = probe_row(name, df, xs, (len(xs),), (spread["sd"], spread["n"]))
        rows.append((*row[:-1], "no_spread" if row[-1] != "skipped" and spread["sd"] < 0.05 else row[-1]))
    passed = sum(1 for r in rows if r[0] in ("TR", "pooled") and r[-1] == "signal" and r[5] > r[7])
    return t.spark.createDataFrame([(*r, passed >= 2) for r in rows], """pool string, n_vehicles bigint, spread double, distinct_scores bigint, residual_sd double, r2 double, null_median double,
        null_p95 double, draws bigint, p_value double, verdict string, weights_may_be_fitted boolean""")


USAGE_DRAWS, USAGE_ALPHAS, USAGE_LEVEL = 100, (0.1, 1.0, 10.0, 100.0), 0.8


def chosen_alpha(folds, columns):
    """The penalty with the least out-of-fold error over these folds; of equal ones the first."""
    whole = sum(folds.values())
    errors = [sum(G.squared_error(m, columns, G.fit(whole - m, columns, a)) for m in folds.values()) for a in USAGE_ALPHAS]
    return USAGE_ALPHAS[int(np.argmin(errors))]


def nested_r2(folds, columns):
    """Out-of-fold R2 where each fold's penalty is chosen on the others alone."""
    whole, left = sum(folds.values()), 0.0
    for k, m in folds.items():
        rest = {f: v for f, v in folds.items() if f != k}
        left += G.squared_error(m, columns, G.fit(whole - m, columns, chosen_alpha(rest, columns)))
    return float(1 - left / G.total_squares(whole))


def grouped_coverage(df, folds, columns, design):
    """(covered share, rows): bands from the training folds' own out-of-fold residuals, asked of the fold left out."""
    whole = sum(folds.values())
    outer, inner = [], []
    for k, m in folds.items():
        rest = {f: v for f, v in folds.items() if f != k}
        outer.append(({"fold": int(k)}, G.fit(whole - m, columns, chosen_alpha(rest, columns))))
        for g, v in rest.items():
            left = {f: u for f, u in rest.items() if f != g}
            inner.append(({"outer": int(k), "fold": int(g)}, G.fit(whole - m - v, columns, chosen_alpha(left, columns))))
    known = {"brand_used": design.levels["brand_used"]}
    wide = G.Design(design.dense + ["usage"], design.levels, {}, "y")
    spark = df.sparkSession
    lines = G.line_table(spark, inner, wide, known).withColumn("fold", F.col("fold").cast("int"))
    resid = G.score(df, lines, ["fold", "brand_used"], wide).select("outer", (F.col("y") - F.col("predicted")).alias("resid"))
    tail = (1 - USAGE_LEVEL) / 2
    bands = R.exact_percentiles(resid, ["outer"], "resid", [tail, 1 - tail], ["lo", "hi"]).select(F.col("outer").cast("int").alias("fold"), "lo", "hi")
    tested = G.score(df, G.line_table(spark, outer, wide, known).withColumn("fold", F.col("fold").cast("int")), ["fold", "brand_used"], wide)
    row = tested.join(bands, "fold").agg(F.avg((F.col("y") - F.col("predicted")).between(F.col("lo"), F.col("hi")).cast("double")).alias("share"), F.count("*").alias("n")).first()
    return row["share"], row["n"]


def usage_probe(df, draws=USAGE_DRAWS):
    """Does a usage class earn a column? Nested R2 with and without it, its null, its sign and its coverage.

    ``df`` has listing_id, fold, brand, y, the dense columns and usage (0 or 1). The null permutes the dummy over the rows.
    """
    xs = ["log1p_age", "log_km", "euro6"]
    counts = G.to_driver(df.groupBy("brand").agg(F.count("*").alias("n")))
    brands = sorted(r["brand"] for r in counts if r["n"] >= 3) + ["other"]
    moved = {c: F.col(c) - SHIFTS.get(c, 0.0) for c in [*xs, "y"]}
    df = cut_lineage(df.select("listing_id", "fold", "usage", *[v.alias(c) for c, v in moved.items()],
                               F.when(F.col("brand").isin(brands), F.col("brand")).otherwise("other").alias("brand_used")))
    design = G.Design(xs, {"brand_used": brands})
    per_fold = {f: design.moments(rows) for f, rows in by_key(G.to_driver(G.moment_cells(df, ["fold", "brand_used"], xs, "y")), "fold").items()}
    sums: dict = {}
    for r in M.permuted_sums(df, "usage", [*xs, "y"], "listing_id", draws, "usage", by=["fold", "brand_used"]).collect():
        for name in {"1^2": ["usage^2"], "1": ["1", f"brand_used_{r.brand_used}"]}.get(r.term, [r.term]):
            sums[r.draw, r.fold, name] = sums.get((r.draw, r.fold, name), 0.0) + r.value
    kept = {}

    def score(folds, columns):
        kept.setdefault("observed", folds)  # draw 0, the order as it is
        return nested_r2(folds, columns)

    scores = permuted_column(per_fold, design, sums, "usage", score)
    observed, null = scores.pop(0), np.array(list(scores.values()))
    columns = [*design.columns, "usage"]
    folds = kept["observed"]
    coefficient = float(G.fit(sum(folds.values()), columns, chosen_alpha(folds, columns)).coef[-1])
    base, n = grouped_coverage(df, per_fold, design.columns, design)
    used, _ = grouped_coverage(df, folds, columns, design)
    return {"without": nested_r2(per_fold, design.columns), "with": observed, "null": null, "coefficient": coefficient, "n": n, "coverage_base": base, "coverage_usage": used}


@query("i15_usage_dummy_probe")
def usage_dummy_probe(t):
    """Four rules for shipping a usage column: above the null's 95th percentile, a negative effect, no loss of coverage, and a held-out make that confirms it.

    The last one is never met by this probe alone, so the column is reported, not shipped.
    """
    df = frame(t).where("market = 'TR'").withColumn("usage", (F.col("model") == "PROMO").cast("double"))
    out = usage_probe(df)
    p95 = float(np.percentile(out["null"], 95))
    beats, negative, covers = out["with"] > p95, out["coefficient"] < 0, out["coverage_usage"] >= out["coverage_base"]
    row = (out["n"], *[round(float(v), 6) for v in (out["without"], out["with"], np.median(out["null"]), p95)], len(out["null"]), round(float(np.mean(out["null"] >= out["with"])), 4),
           round(out["coefficient"], 6), round(out["coverage_base"], 4), round(out["coverage_usage"], 4), bool(beats), bool(negative), bool(covers), False)
    return t.spark.createDataFrame([row], """n bigint, r2_without double, r2_with double, null_median double, null_p95 double, draws bigint, p_value double, coefficient double,
        coverage_without double, coverage_with double, beats_null boolean, negative_effect boolean, keeps_coverage boolean, ship boolean""")


def rank_auc(df, score, flag):
    """Area under the ROC curve from average-tie ranks."""
    r = R.rank_with_ties(df, [], score, "_r")
    pos = F.sum(F.when(F.col(flag), F.col("_r")))
    n1, n0 = F.count_if(F.col(flag)), F.count_if(~F.col(flag))
    return r.agg(((pos - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"), n1.alias("positives"), n0.alias("negatives"))


@query("i17_degradation_head_auc", "photos twins", """
a AS (SELECT 'o' AS k, path, blur FROM photos UNION ALL SELECT 'd', path, blur FROM twins),
r AS (SELECT k, rank() OVER (ORDER BY -blur) + (count(*) OVER (PARTITION BY blur) - 1) / 2.0::DOUBLE AS r FROM a)
SELECT round((sum(CASE WHEN k = 'd' THEN r END) - count_if(k = 'd') * (count_if(k = 'd') + 1) / 2) / (count_if(k = 'd') * count_if(k = 'o')), 6) AS auc, count_if(k = 'd') AS positives, count_if(k = 'o') AS negatives FROM r""")
def degradation_auc(t):
    rows = t.photos.select((-F.col("blur")).alias("s"), F.lit(False).alias("deg")).unionByName(t.twins.select((-F.col("blur")).alias("s"), F.lit(True).alias("deg")))
    return rank_auc(rows, "s", "deg").withColumn("auc", F.round("auc", 6))


FOLDS, FALSE_FLAGS, SEVERITY_ALPHA = 5, 0.05, 10.0
CAPTURE = ["sharpness", "brightness", "contrast", "dark_frac", "bright_frac"]


def corrupted(t):
    """Every photo and its corrupted copy: variant, vehicle fold, capture metrics, severity and a 0/1 column for each of the 14 corruptions.

    The copy's corruptions and severity are the drawn plan's; its metrics move as the corruptions say.
    """
    atoms = sorted(S.CORRUPTION_WEIGHTS)
    plan = S.weighted_draw(t.photos.select("path"), ["path"], S.CORRUPTION_WEIGHTS, 9)
    plan = plan.select("path", "chosen", F.round(S.triangular(uniform("9#s", "path"), 0.15, 0.55, 1.0), 3).alias("strength"))
    has = lambda *names: F.arrays_overlap("chosen", F.array(*[F.lit(n) for n in names])).cast("double") * F.col("strength")
    columns = ["path", "source_key", "listing_id", "blur", "brightness", "contrast", "dark_frac", "bright_frac"]
    clean = t.photos.select(*columns, F.lit("original").alias("variant"), F.lit(0.0).alias("severity"), *[F.lit(0).alias(a) for a in atoms])
    worn = t.photos.select(*columns).join(plan, "path").withColumns({
        "blur": F.col("blur") * (1 - 0.7 * has("motion_blur", "defocus", "downscaled")),
        "brightness": F.col("brightness") - 0.5 * has("underexposed", "low_light_noise") + 0.4 * has("overexposed", "sun_glare"),
        "contrast": F.col("contrast") * (1 - 0.5 * has("jpeg_crush", "rain", "mud_spatter")),
        "dark_frac": F.col("dark_frac") + 0.4 * has("harsh_shadow", "underexposed"),
        "bright_frac": F.col("bright_frac") + 0.4 * has("sun_glare", "overexposed")})
    worn = worn.select(*columns, F.lit("degraded").alias("variant"), F.col("strength").alias("severity"), *[F.array_contains("chosen", a).cast("int").alias(a) for a in atoms])
    both = clean.unionByName(worn).withColumn("fold", fold_of(F.concat_ws("/", "source_key", "listing_id"), FOLDS)).withColumn("sharpness", F.log1p("blur"))
    return cut_lineage(both.select("path", "variant", "fold", "severity", *CAPTURE, *atoms)), atoms


@query("i17_degradation_heads")
def degradation_heads(t):
    """All 14 corruption heads over five vehicle-grouped folds: held-out AUC of each, of any of them against a clean photo, and the mean."""
    rows, atoms = corrupted(t)
    heads = D.fit_heads(rows, CAPTURE, atoms)
    scored = cut_lineage(D.held_out_scores(rows, heads, ["variant", *atoms]))
    each = cut_lineage(D.head_aucs(scored, atoms, {a: a for a in atoms}))
    any_ = rank_auc(scored.select(F.array_max("scores").alias("p"), (F.col("variant") == "degraded").alias("deg")), "p", "deg")
    any_ = any_.select(F.lit("degraded_vs_original").alias("head"), "auc", "positives", "negatives")
    mean = each.agg(F.lit("mean_of_heads").alias("head"), F.avg("auc").alias("auc"), F.lit(None).cast("bigint").alias("positives"), F.lit(None).cast("bigint").alias("negatives"))
    return each.unionByName(any_).unionByName(mean).withColumn("auc", F.round("auc", 4))


@query("i17_packed_heads")
def packed_heads(t):
    """The heads fitted on all photos, as stored: coefficient, intercept, mean and scale of each column."""
    rows, atoms = corrupted(t)
    return t.spark.createDataFrame(D.fit_heads(rows, CAPTURE, atoms).packed(), "head string, feature string, coef double, intercept double, mean double, scale double")


# The same rows in the statement: the drawn plan, then the metrics as the corruptions move them.
CORRUPTED_SQL = """
n(name, w) AS (VALUES """ + ", ".join(f"('{n}', {w})" for n, w in S.CORRUPTION_WEIGHTS.items()) + """),
u AS (SELECT path, (('0x' || substr(md5('9#k|' || path), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE AS uk, (('0x' || substr(md5('9#s|' || path), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE AS us FROM photos),
seats AS (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY -ln((('0x' || substr(md5('9#' || name || '|' || path), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE) / w::DOUBLE, name) AS seat FROM photos, n),
drawn AS (SELECT path, list(name) AS l FROM seats JOIN u USING (path) WHERE seat <= CASE WHEN uk <= 0.4 THEN 2 WHEN uk <= 0.8 THEN 3 ELSE 4 END GROUP BY 1),
plan AS (SELECT path, CASE WHEN list_contains(l, 'underexposed') AND list_contains(l, 'overexposed') THEN [x for x in l if x <> 'overexposed'] ELSE l END AS l,
  round(CASE WHEN us < 0.4 / 0.85 THEN 0.15 + sqrt(us * 0.85 * 0.4) ELSE 1.0 - sqrt((1 - us) * 0.85 * 0.45) END, 3) AS k FROM drawn JOIN u USING (path)),
both_rows AS (SELECT path, 'original' AS variant, source_key, listing_id, 0.0::DOUBLE AS severity, blur, brightness, contrast, dark_frac, bright_frac FROM photos UNION ALL
  SELECT path, 'degraded', source_key, listing_id, k, blur * (1 - 0.7::DOUBLE * k * list_has_any(l, ['motion_blur', 'defocus', 'downscaled'])::INT),
   brightness - 0.5::DOUBLE * k * list_has_any(l, ['underexposed', 'low_light_noise'])::INT + 0.4::DOUBLE * k * list_has_any(l, ['overexposed', 'sun_glare'])::INT,
   contrast * (1 - 0.5::DOUBLE * k * list_has_any(l, ['jpeg_crush', 'rain', 'mud_spatter'])::INT), dark_frac + 0.4::DOUBLE * k * list_has_any(l, ['harsh_shadow', 'underexposed'])::INT,
   bright_frac + 0.4::DOUBLE * k * list_has_any(l, ['sun_glare', 'overexposed'])::INT FROM photos JOIN plan USING (path)),
d AS (SELECT path || variant AS id, variant, ('0x' || substr(md5(source_key || '/' || listing_id), 1, 8))::BIGINT % 5 AS fold, ln(1 + blur) AS x1, brightness AS x2, contrast AS x3, dark_frac AS x4, bright_frac AS x5, severity AS z FROM both_rows),
long AS (SELECT id, fold, unnest([{'i': 0, 'x': 1.0::DOUBLE}, {'i': 1, 'x': x1}, {'i': 2, 'x': x2}, {'i': 3, 'x': x3}, {'i': 4, 'x': x4}, {'i': 5, 'x': x5}, {'i': 999, 'x': z}], recursive := true) FROM d),
moments AS (SELECT 'all' AS tag, s.fold, s.i, t.i AS j, sum(s.x * t.x) AS v FROM long s JOIN long t USING (id) GROUP BY ALL),""" + ridge_sql("fit", "moments", 5, alpha=SEVERITY_ALPHA) + """,
scored AS (SELECT d.variant, d.z, d.z - r.r AS p FROM d JOIN (SELECT l.id, sum(l.x * f.b) AS r FROM long l JOIN fit_beta f ON f.fold = l.fold AND f.i = l.i GROUP BY 1) r ON r.id = d.id),
cut AS (SELECT quantile_cont(p, 0.95) AS cut FROM scored WHERE variant = 'original')"""


@query("i17_severity_regressor", "photos", "WITH_RECURSIVE " + CORRUPTED_SQL + """
SELECT count(*) AS n, round((SELECT r2 FROM fit_r2), 4) AS severity_r2, round(any_value(cut), 4) AS fine_detail_severity, 0.05::DOUBLE AS false_flag_rate,
 round(avg((p >= cut)::INT) FILTER (WHERE variant = 'degraded'), 4) AS degraded_caught FROM scored, cut""")
def severity_regressor(t):
    """Severity from capture metrics, out of fold; the cut that flags one clean photo in twenty, and the share of degraded ones it catches."""
    rows, _ = corrupted(t)
    design = G.Design(CAPTURE, {}, {}, "severity")
    cells = G.to_driver(G.moment_cells(rows, ["fold"], CAPTURE, "severity"))
    per_fold = {c["fold"]: design.moments([c]) for c in cells}
    whole = sum(per_fold.values())
    fits = [({"fold": int(f)}, G.fit(whole - m, CAPTURE, SEVERITY_ALPHA)) for f, m in per_fold.items()]
    left = sum(G.squared_error(per_fold[tag["fold"]], CAPTURE, fit) for tag, fit in fits)
    lines = G.line_table(t.spark, fits, design, {}).withColumn("fold", F.col("fold").cast("int"))
    scored = cut_lineage(G.score(rows, lines, ["fold"], design).select("variant", "predicted"))
    cut = R.exact_percentiles(scored.where("variant = 'original'"), [], "predicted", [1 - FALSE_FLAGS], ["cut"])
    caught = F.avg(F.when(F.col("variant") == "degraded", (F.col("predicted") >= F.col("cut")).cast("double")))
    out = R.with_row(scored, cut, "cut").agg(F.count("*").alias("n"), F.round(F.lit(float(1 - left / G.total_squares(whole))), 4).alias("severity_r2"),
                                             F.round(F.max("cut"), 4).alias("fine_detail_severity"), F.lit(FALSE_FLAGS).alias("false_flag_rate"), F.round(caught, 4).alias("degraded_caught"))
    return out


def labelled_vectors(t):
    """(vec_id, x, label, fold): every embedding with its label; the photos of a vehicle share a fold."""
    vehicle = F.floor(F.col("vec_id") / 2).cast("string")
    return cut_lineage(t.embeddings.where("embedding is not null and label is not null").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("string").alias("label"), fold_of(vehicle, FOLDS).alias("fold")))


@query("i18_view_and_brand_heads")
def view_and_brand_heads(t):
    """The view head over five vehicle-grouped folds: agreement with the teacher, and twin agreement beside that of zero-shot tags.

    The two photos of a vehicle stand for an original and its degraded twin.
    """
    rows = labelled_vectors(t)
    heads = D.fit_softmax(rows, "x", "label")
    held = cut_lineage(D.held_out_classes(rows, heads, "x", ["vec_id", "label"]))
    tags = V.zero_shot(t.embeddings, "embedding", bank(t), 25.0).select("vec_id", F.col("tag").cast("string").alias("tag"))
    pair = held.join(tags, "vec_id").groupBy(F.floor(F.col("vec_id") / 2).alias("pair")).agg(
        F.count("*").alias("k"), (F.min("predicted") == F.max("predicted")).cast("double").alias("same"), (F.min("tag") == F.max("tag")).cast("double").alias("same_tag")).where("k = 2")
    agree = pair.agg(F.count("*").alias("n_pairs"), F.avg("same").alias("twin_agreement_head"), F.avg("same_tag").alias("twin_agreement_zeroshot"))
    top = held.groupBy("label").agg(F.count("*").alias("k")).agg((F.max("k") / F.sum("k")).alias("majority"))
    acc = held.agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("agreement_with_teacher"))
    out = R.with_row(R.with_row(acc, top, "majority"), agree, "n_pairs", "twin_agreement_head", "twin_agreement_zeroshot")
    return out.select("n", "n_pairs", *[F.round(c, 4).alias(c) for c in ("agreement_with_teacher", "majority", "twin_agreement_head", "twin_agreement_zeroshot")])


@query("i18_brand_head")
def brand_head(t):
    """Make from a vehicle's mean vector, one row a vehicle, five folds, against the commonest make."""
    vectors, names = vehicle_embeddings(t)
    makes = t.listings.groupBy(F.split_part("listing_id", F.lit("-"), F.lit(1)).alias("vehicle")).agg(F.min_by("make", "listing_id").alias("make"))
    rows = vectors.join(makes.where("make is not null"), "vehicle").select(
        "vehicle", L.normal_brand(F.col("make")).alias("label"), F.array(*names).alias("x"), fold_of(F.col("vehicle"), FOLDS).alias("fold"))
    rows = cut_lineage(rows)
    held = cut_lineage(D.held_out_classes(rows, D.fit_softmax(rows, "x", "label"), "x", ["vehicle", "label"]))
    top = held.groupBy("label").agg(F.count("*").alias("k")).agg((F.max("k") / F.sum("k")).alias("majority"), F.count("*").alias("n_classes"))
    acc = held.agg(F.count("*").alias("n_vehicles"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    return R.with_row(acc, top, "majority", "n_classes").select("n_vehicles", "n_classes", F.round("accuracy", 4).alias("accuracy"), F.round("majority", 4).alias("majority_baseline"))


@query("i18_framing_head")
def framing_head(t):
    """Whole vehicle or part, fitted on the dev split alone: accuracy on the test split, and parts called whole there."""
    split = F.when(fold_of(F.concat(F.lit("framing|"), F.floor(F.col("vec_id") / 2).cast("string")), 10) < 7, 0).otherwise(1)
    framing = F.when(F.col("label") < 5, "whole").otherwise("part")
    rows = cut_lineage(t.embeddings.where("embedding is not null and label is not null").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), framing.alias("framing"), split.alias("split")))
    heads = D.fit_softmax(rows, "x", "framing", fold="split")  # the fit that leaves split 1 out is the dev fit
    held = D.held_out_classes(rows.where("split = 1"), heads, "x", ["framing"], fold="split")
    wrong = F.avg(F.when(F.col("framing") == "part", (F.col("predicted") == "whole").cast("double")))
    return held.agg(F.count("*").alias("n_test"), F.round(F.avg((F.col("framing") == F.col("predicted")).cast("double")), 4).alias("held_out_acc"), F.round(wrong, 4).alias("dangerous_error"))


@query("i19_apply_linear_heads", oracle=EMB_SQL + """,
z AS (SELECT vec_id, j, 1 / (1 + exp(-greatest(-30, least(30, 4 * list_sum([v[i] * ((i * j) % 5 - 2) for i in range(1, 65)]) / 8 + 0.1 * j)))) AS p FROM e, (SELECT unnest(range(0, 6)) AS j)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, j) AS k FROM z)
SELECT vec_id, coalesce(string_agg('atom' || CAST(j AS VARCHAR), '|' ORDER BY k) FILTER (WHERE k <= 3 AND p >= 0.5), '') AS labels, round(max(p), 4) AS best FROM r GROUP BY 1""")
def apply_linear_heads(t):
    coef = np.array([[((i * j) % 5 - 2) * 4 / 8 for i in range(1, 65)] for j in range(6)], dtype=float)
    out = V.apply_heads(t.embeddings, "embedding", coef, 0.1 * np.arange(6), [f"atom{j}" for j in range(6)], 3, 0.5)
    return out.select("vec_id", F.array_join("labels", "|").alias("labels"), F.round("best", 4).alias("best"))


@query("k01_injected_embedder", oracle="""
SELECT doc_id, round(length(text) / 1000.0::DOUBLE, 4) AS e1, round((length(text) - length(replace(text, ' ', ''))) / 1000.0::DOUBLE, 4) AS e2 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def injected_embedder(t):
    """Only rows without a stored vector reach the caller's embedding function."""
    from ..sources.store import embed_missing

    def embed(texts):
        return np.array([[len(x) / 1000, x.count(" ") / 1000] for x in texts])

    fresh = embed_missing(t.documents.select("doc_id", "text"), t.labels.select("doc_id"), "doc_id", "text", embed)
    return fresh.select("doc_id", F.round(F.element_at("emb", 1), 4).alias("e1"), F.round(F.element_at("emb", 2), 4).alias("e2"))
