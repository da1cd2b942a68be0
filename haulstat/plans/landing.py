"""Landing queries: pages, answers, planned calls, leak guard, run log."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as I  # noqa: F401  (kept importable for callers of this module)
from ..sources import landing as D
from ..sources import store
from .registry import query

c = F.col

SPEC_FIELDS = "page_id, title, price, make, model, year, km, warranty, n_images"


def spec_pages(t):
    """The given pages with a spec list, a price, and a gallery put into their mark-up."""
    def item(value, label):
        return F.concat(F.lit("<li>\n <span>"), value, F.lit(f"</span> <p>{label}</p></li>"))

    pid = c("page_id")
    block = F.concat(
        F.lit('<div class="page-detail-top-title"><div class="text"><span>'), F.when(pid % 6 == 0, "0").otherwise(F.concat((pid * 1000 + 5).cast("string"), F.lit(".000"))), F.lit(" ₺</span></div></div>"),
        F.lit('<ul class="list-type-col">'), item(F.concat(F.lit("<b>Brand#"), (pid % 25).cast("string"), F.lit("</b>")), "Marka"), item(F.lit("F&amp;MAX"), "Model"),
        item((pid % 20 + 2005).cast("string"), "Model Yılı"), item(F.concat((pid % 900).cast("string"), F.lit(".500 km")), "Km"),
        item(F.when(pid % 2 == 0, "Evet").otherwise("Yok"), "Garanti"), item(F.lit("x"), "Bilinmeyen"), F.lit("</ul>"),
        F.lit('<a href="https://img.example/1_Buyuk.jpg" data-fancybox="gallery"><a href="https://img.example/'), (pid % 3).cast("string"), F.lit('_Buyuk.jpg" data-fancybox="gallery">'))
    return t.pages.select("page_id", F.concat("html", block).alias("html"))


@query("a05_spec_list_pages", oracle="""
SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<h1>(.*?)</h1>') THEN nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g')), '') END AS title,
 CASE WHEN page_id % 6 <> 0 THEN (page_id * 1000 + 5) * 1000 END AS price, 'Brand#' || CAST(page_id % 25 AS VARCHAR) AS make, 'F&MAX' AS model, CAST(page_id % 20 + 2005 AS INTEGER) AS year,
 (page_id % 900) * 1000 + 500 AS km, page_id % 2 = 0 AS warranty, CAST(CASE WHEN page_id % 3 = 1 THEN 1 ELSE 2 END AS INTEGER) AS n_images FROM pages""")
def spec_list_pages(t):
    out = D.parse_spec_pages(spec_pages(t))
    return out.select("page_id", F.trim("title").alias("title"), "price", "make", "model", "year", "km", "warranty", "n_images")


@query("b01_spec_labels", oracle="""
SELECT 'make' AS field, count(*) AS pages FROM pages UNION ALL SELECT 'model', count(*) FROM pages UNION ALL SELECT 'year', count(*) FROM pages UNION ALL SELECT 'km', count(*) FROM pages UNION ALL SELECT 'warranty', count(*) FROM pages""")
def spec_labels(t):
    return D.parse_spec_pages(spec_pages(t)).select(F.explode(F.map_keys("spec")).alias("field")).groupBy("field").agg(F.count("*").alias("pages"))


@query("a05_embedded_state_pages", oracle="""
SELECT page_id, 'M' || CAST(page_id AS VARCHAR) AS listing_id, CASE page_id % 3 WHEN 0 THEN 'TR' ELSE 'US' END AS market, CAST(2000 + page_id % 25 AS INTEGER) AS year,
 CASE WHEN page_id % 7 <> 0 THEN CAST(round_even((page_id * 13 % 100) * 1000 + 0.5, 0) AS BIGINT) END AS km, CASE WHEN page_id % 5 <> 0 THEN page_id * 10.0::DOUBLE END AS price, CAST(1 AS INTEGER) AS n_images
FROM pages WHERE page_id % 3 <> 2 AND page_id % 11 <> 0""")
def embedded_state_pages(t):
    pid = c("page_id")
    asset = F.to_json(F.struct(
        F.concat(F.lit("M"), pid.cast("string")).alias("mascusID"), F.when(pid % 3 == 0, "tr").when(pid % 3 == 1, "US").otherwise("ZZ").alias("country"), F.lit("MAN").alias("brand"),
        (pid % 25 + 2000).alias("year"), F.when(pid % 7 == 0, 0.0).otherwise((pid * 13 % 100) * 1000 + 0.5).alias("meterReadoutKilometers"),
        F.when(pid % 5 == 0, 0.0).otherwise(pid * 10.0).alias("priceOriginal"), F.lit("private").alias("sellerPhone"),
        F.array(F.lit("//x/image/product/medium/1.jpg"), F.lit("https://x/image/product/large/1.jpg"), F.lit("https://x/imagetilewm/2.jpg")).alias("imagesSmallUrls")))
    blob = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"assetDetails":'), asset,
                    F.when(pid % 11 == 0, "").otherwise("}}}"), F.lit("</script>"))
    out = D.parse_state_pages(t.pages.select("page_id", F.concat("html", blob).alias("html")), ["TR", "US"])
    return out.where("year is not null").select("page_id", "listing_id", "market", "year", "km", "price", F.size(F.array_distinct(F.transform("image_urls", lambda u: F.substring_index(u, "/", -1)))).alias("n_images"))


@query("a05_result_objects", oracle="""
j AS (SELECT o_orderkey, o_orderkey % 5000 AS uvid, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Semitrailers' ELSE 'Tractor Units ' END AS vt, o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS sold,
  CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS price, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE year(o_orderdate) + 20 END AS y, o_custkey + 1 AS km FROM orders),
b AS (SELECT *, CASE WHEN vt = 'Semitrailers' THEN 'wrong_type' WHEN sold THEN 'sold' WHEN price = 0 THEN 'no_price' WHEN y IS NULL THEN 'no_year_or_km' END AS bad FROM j),
f AS (SELECT uvid, min(o_orderkey) AS first FROM b WHERE bad IS NULL GROUP BY 1)
SELECT CASE WHEN first IS NOT NULL AND o_orderkey > first THEN 'duplicate' ELSE coalesce(bad, 'kept') END AS outcome, count(*) AS n FROM b LEFT JOIN f USING (uvid) GROUP BY 1""")
def result_objects(t):
    k = c("o_orderkey")
    result = F.to_json(F.struct(
        (k % 5000).cast("string").alias("uvid"), F.when(c("o_orderpriority") == "1-URGENT", "Semitrailers").otherwise("Tractor Units ").alias("vehicleType"),
        ((c("o_orderstatus") == "P") & (k % 2 == 0)).alias("sold"), F.when(k % 9 == 0, "").otherwise(F.concat(F.floor("o_totalprice").cast("string"), F.lit(" EUR"))).alias("priceNet"),
        F.lit("0").alias("priceTotal"), F.when(k % 10 == 0, "unknown").otherwise(F.concat(F.lit("4/"), (F.year("o_orderdate") + 20).cast("string"))).alias("dateOfRegistration"),
        (c("o_custkey") + 1).cast("string").alias("km"), F.lit("MAN TGX").alias("title")))
    out = D.parse_result_objects(t.orders.select("o_orderkey", result.alias("result")), "o_orderkey")
    return out.groupBy(F.coalesce("skipped", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


PLANNED = "planned AS (SELECT role AS suite, sha256('prompt:' || strlen(text) || ':' || text || ';' || 'model:' || strlen(role) || ':' || role || ';') AS key, conv_id FROM conversations)"


def planned(t):
    return t.conversations.select(c("role").alias("suite"), store.response_key({"prompt": c("text"), "model": c("role")}).alias("key"), "conv_id")


@query("a08_planned_call_bill", oracle=PLANNED + """,
a AS (SELECT DISTINCT key FROM planned WHERE conv_id % 3 = 0), k AS (SELECT suite, key, count(*) AS n FROM planned GROUP BY 1, 2)
SELECT suite, sum(n) AS planned, sum(CASE WHEN key IN (SELECT key FROM a) THEN n ELSE 0 END) AS answered, count_if(key NOT IN (SELECT key FROM a)) AS to_pay FROM k GROUP BY 1""")
def planned_call_bill(t):
    p = planned(t)
    return store.resolve_planned(p, p.where("conv_id % 3 = 0"), ["suite"])


@query("g20_replay_survival", oracle=PLANNED + """
SELECT count(*) AS recorded, count_if(key IN (SELECT key FROM planned WHERE conv_id % 4 <> 1)) AS survives FROM (SELECT DISTINCT key FROM planned)""")
def replay_survival(t):
    p = planned(t)
    recorded = p.select("key").distinct()
    cache = p.where("conv_id % 4 <> 1").select("key").distinct().withColumn("hit", F.lit(1))
    return recorded.join(cache, "key", "left").agg(F.count("*").alias("recorded"), F.count("hit").alias("survives"))


@query("a07_missing_embeddings", oracle="SELECT d.source, count(*) AS to_embed FROM documents d WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1")
def missing_embeddings(t):
    stored = t.embeddings.select(c("vec_id").alias("doc_id"))
    return t.documents.select("doc_id", "source").join(stored, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("to_embed"))


@query("a09_run_trace", oracle="""
SELECT user_id AS run_id, event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def run_trace(t):
    """Events with their JSON payload; a line that does not parse is left out."""
    return parsed_events(t.events.select(c("user_id").alias("run_id"), "event_id", "event_type", "props"))


def parsed_events(events):
    """(run_id, event_id, event_type, k) of the events whose ``props`` parse; null and broken payloads are left out."""
    k = F.from_json("props", "k bigint, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return events.withColumn("d", k).where("d is not null and d._broken is null").select("run_id", "event_id", "event_type", "d.k")


@query("l01_recent_runs", oracle="""
r AS (SELECT user_id AS run_id, max(ts) AS last_seen, count_if(event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY 1)
SELECT run_id, last_seen, errors, n FROM r WHERE errors > 0 ORDER BY last_seen DESC, run_id LIMIT 10""")
def recent_runs(t):
    r = t.events.groupBy(c("user_id").alias("run_id")).agg(F.max("ts").alias("last_seen"), F.count_if(c("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    return r.where("errors > 0").orderBy(F.desc("last_seen"), "run_id").limit(10)


def answers(t):
    """Answers as a model writes them: fenced, chatty, cut off, with fields that cannot be read."""
    one = F.to_json(F.struct((c("turn") % 3 != 0).alias("legible"), F.array(F.struct(
        F.when(c("turn") % 5 == 0, "").otherwise("corrosion").alias("component"), F.when(c("turn") % 4 == 3, " ").otherwise(c("text")).alias("observation"),
        F.when(c("turn") % 2 == 0, "major").otherwise("terrible").alias("severity"), F.lit("high").alias("price_impact"),
        F.when(c("conv_id") % 3 == 0, "1.7").when(c("conv_id") % 3 == 1, "n/a").otherwise("0.4").alias("confidence"))).alias("observations")))
    text = (F.when(c("conv_id") % 4 == 0, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(c("conv_id") % 4 == 1, F.concat(F.lit("Here it is: "), one, F.lit(" Done.")))
            .when(c("conv_id") % 4 == 2, F.concat(F.lit("{"), one)).otherwise(one))
    return t.conversations.select("conv_id", "turn", text.alias("response"))


@query("a11_answers_to_findings", oracle="""
SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'other' ELSE 'corrosion' END AS component, length(trim(text)) AS n_chars, CASE WHEN turn % 2 = 0 THEN 'major' ELSE 'cosmetic' END AS severity,
 CASE conv_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 ELSE 0.4 END::DOUBLE AS confidence, turn % 2 <> 0 AS ungraded FROM conversations WHERE conv_id % 4 <> 2 AND turn % 4 <> 3""")
def answers_to_findings(t):
    out = D.findings_of(D.parse_answers(answers(t), ["conv_id", "turn"]), ["conv_id", "turn"])
    return out.select("conv_id", "turn", "component", F.length("observation").cast("bigint").alias("n_chars"), "severity", "confidence", "ungraded")


@query("a11_quarantine", oracle="SELECT conv_id, turn FROM conversations WHERE conv_id % 4 = 2")
def answer_quarantine(t):
    return D.parse_answers(answers(t), ["conv_id", "turn"]).where("parsed is null").select("conv_id", "turn")


@query("a10_panel_ingest", oracle="""
SELECT conv_id, turn, concat_ws(',', CASE WHEN turn = 7 THEN 'not_json' END, CASE WHEN turn <> 7 AND turn % 3 = 0 THEN 'components_missing' END, CASE WHEN turn <> 7 AND turn % 5 = 1 THEN 'components_unknown' END,
 CASE WHEN turn <> 7 AND conv_id % 4 = 0 THEN 'severity_unknown' END, CASE WHEN turn <> 7 AND conv_id % 4 <> 0 AND turn % 2 = 0 THEN 'no_photo_cited' END, CASE WHEN turn <> 7 AND turn % 2 = 1 AND conv_id % 6 >= 5 THEN 'photo_outside' END,
 CASE WHEN turn <> 7 AND conv_id % 7 = 0 THEN 'grade_unknown' END, CASE WHEN turn <> 7 AND trim(text) = '' THEN 'grade_reason_missing' END, CASE WHEN turn <> 7 AND conv_id % 8 = 0 THEN 'confidence_outside' END) AS errors FROM conversations""")
def panel_ingest(t):
    level = F.when(c("conv_id") % 4 == 0, "awful").otherwise("minor")
    photos = F.when(c("turn") % 2 == 0, F.array().cast("array<int>")).otherwise(F.array((c("conv_id") % 6).cast("int")))
    entry = F.struct(level.alias("severity"), photos.alias("photos"))
    extra = F.when(c("turn") % 5 == 1, "gearbox").otherwise("fuel_tank")
    keys = F.when(c("turn") % 3 == 0, F.array(extra)).otherwise(F.array(F.lit("mirrors_visor"), F.lit("cab_steps"), extra))
    # The two other components are missing on every third turn; an odd name is unknown.
    keys = F.when((c("turn") % 3 != 0) & (c("turn") % 5 == 1), F.array_union(keys, F.array(F.lit("fuel_tank")))).otherwise(keys)
    body = F.to_json(F.struct(F.map_from_arrays(keys, F.transform(keys, lambda k: entry)).alias("components"), F.when(c("conv_id") % 7 == 0, "superb").otherwise("fair").alias("grade"),
                              F.trim("text").alias("grade_reason"), F.when(c("conv_id") % 8 == 0, 1.5).otherwise(0.5).alias("confidence")))
    rows = t.conversations.select("conv_id", "turn", F.when(c("turn") == 7, "no answer").otherwise(F.concat(F.lit("Answer: "), body)).alias("response"))
    parsed = F.when(F.try_parse_json(D.json_body(c("response"))).isNotNull(), F.from_json(D.json_body(c("response")), D.PANEL))
    checked = rows.withColumn("a", parsed)
    errors = D.panel_errors(c("a"), F.lit(5), ["mirrors_visor", "cab_steps", "fuel_tank"])
    return checked.select("conv_id", "turn", F.array_join(errors, ",").alias("errors"))


@query("a12_price_word_guard", oracle="""
SELECT doc_id, regexp_extract(text, '(?i)(₺|\\$|€|£|\\bTRY\\b|\\bUSD\\b|\\bTL\\b|\\blira\\b|\\bdolar\\b|\\bEUR\\b|\\bprice[sd]?\\b|\\bpricing\\b|\\bcost(?:s|ing)?\\b|\\bfiyat\\b|\\bworth\\s+(?:about\\s+|around\\s+|roughly\\s+)?[₺$€£\\d]|\\bexpensive\\b|\\bcheap(?:er|est)?\\b)', 1) AS hit
FROM documents WHERE regexp_matches(text, '(?i)(₺|\\$|€|£|\\bTRY\\b|\\bUSD\\b|\\bTL\\b|\\blira\\b|\\bdolar\\b|\\bEUR\\b|\\bprice[sd]?\\b|\\bpricing\\b|\\bcost(?:s|ing)?\\b|\\bfiyat\\b|\\bworth\\s+(?:about\\s+|around\\s+|roughly\\s+)?[₺$€£\\d]|\\bexpensive\\b|\\bcheap(?:er|est)?\\b)')""")
def price_word_guard(t):
    return D.price_leaks(t.documents.select("doc_id", "text"), "doc_id", "text")


@query("a12_card_leaks", oracle="""
n AS (SELECT doc_id // 10 AS card_id, text, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1 AS k FROM documents)
SELECT card_id, '[0].known_weak_points[' || k || '].note' AS path, regexp_extract(text, '(?i)(₺|\\$|€|£|\\bTRY\\b|\\bUSD\\b|\\bTL\\b|\\blira\\b|\\bdolar\\b|\\bEUR\\b|\\bprice[sd]?\\b|\\bpricing\\b|\\bcost(?:s|ing)?\\b|\\bfiyat\\b|\\bworth\\s+(?:about\\s+|around\\s+|roughly\\s+)?[₺$€£\\d]|\\bexpensive\\b|\\bcheap(?:er|est)?\\b)', 1) AS hit FROM n
WHERE regexp_matches(text, '(?i)(₺|\\$|€|£|\\bTRY\\b|\\bUSD\\b|\\bTL\\b|\\blira\\b|\\bdolar\\b|\\bEUR\\b|\\bprice[sd]?\\b|\\bpricing\\b|\\bcost(?:s|ing)?\\b|\\bfiyat\\b|\\bworth\\s+(?:about\\s+|around\\s+|roughly\\s+)?[₺$€£\\d]|\\bexpensive\\b|\\bcheap(?:er|est)?\\b)')""")
def card_leaks(t):
    """Nested reference cards, ten texts each: the path of every note that reads as money; sources and basis are not read."""
    notes = t.documents.groupBy(F.floor(F.col("doc_id") / 10).alias("card_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("l"))
    model = F.struct(F.concat(F.lit("model "), F.col("card_id").cast("string")).alias("name"), F.transform("l", lambda x: F.struct(x["text"].alias("note"))).alias("known_weak_points"),
                     F.transform("l", lambda x: x["text"]).alias("sources"), F.struct(F.get("l", F.lit(0))["text"].alias("text")).alias("basis"))
    cards = notes.select("card_id", F.to_json(F.struct(F.lit("no price here is read").alias("header"), F.array(model).alias("models"))).alias("card"))
    return D.card_leaks(cards, "card_id", "card").drop("excerpt")


@query("a06_package_columns", "photos listings", """
SELECT source_key, listing_id, image_index, variant, path, view FROM photos""")
def package_columns(t):
    """The fixed column list of the packaged table, as the Parquet sink writes it."""
    from ..operators.corpus import with_quality
    return with_quality(t.photos).select("source_key", "listing_id", "image_index", "variant", "path", "view")


@query("l06_ordered_distinct", oracle="""
SELECT doc_id, len(list_distinct(string_split(text, ' '))) AS n_distinct FROM documents""")
def ordered_distinct(t):
    """Order-preserving distinct inside a row."""
    return t.documents.select("doc_id", F.size(F.array_distinct(F.split("text", " "))).cast("bigint").alias("n_distinct"))
