"""Landed pages and landed model answers -> typed rows, with every refusal counted."""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import condition as C
from ..functions import listings as L
from ..functions import text as X

# Spec labels, seller-field prefixes that never leave a page, price words, levels.
SPEC_LABELS = {"Marka": "make", "Model": "model", "Araç Tipi": "body_type", "Model Yılı": "year", "Km": "km",
               "Vites Tipi": "transmission", "Renk": "color", "Kullanım Amacı": "usage_class", "5.Teker": "fifth_wheel_height_mm",
               "Yetki Belgesi": "authorisation_certificate", "Şehir": "city", "Çekiş Tipi": "drive_type", "Garanti": "warranty",
               "İlan Numarası": "ad_number"}
PRIVATE_PREFIXES = ("seller", "contact", "phone", "email")
PRICE_WORDS = (r"(?i)(₺|\$|€|£|\bTRY\b|\bUSD\b|\bTL\b|\blira\b|\bdolar\b|\bEUR\b|\beuros?\b(?!\s*-?\s*(?:[0-9]|VI\b|V\b|IV\b|III\b))"
               r"|\bprice[sd]?\b|\bpricing\b|\bcost(s|ing)?\b|\bfiyat\b|\bworth\s+(?:about\s+|around\s+|roughly\s+)?[₺$€£\d]|\bexpensive\b|\bcheap(er|est)?\b)")
PRICE_WORDS = X.ascii_edges(PRICE_WORDS)
CONFIDENCE_UNREADABLE = 0.3


def plain_text(html: Column) -> Column:
    """Mark-up removed, the common entities decoded, trimmed."""
    out = F.regexp_replace(html, "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def spec_map(html: Column) -> Column:
    """Label -> value of every ``<li><span>value</span><p>label</p></li>``, labels renamed, unknown ones dropped."""
    item = r"(?s)<li>\s*<span>(.*?)</span>\s*<p>(.*?)</p>"
    values, labels = F.regexp_extract_all(html, F.lit(item), 1), F.regexp_extract_all(html, F.lit(item), 2)
    names = L.alias_map(SPEC_LABELS)
    pairs = F.zip_with(labels, values, lambda k, v: F.struct(F.element_at(names, plain_text(k)).alias("key"), plain_text(v).alias("value")))
    known = F.filter(pairs, lambda p: p["key"].isNotNull())
    # A label that is repeated keeps its last value.
    last = F.aggregate(known, F.create_map().cast("map<string,string>"),
                       lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))
    return last


def parse_spec_pages(pages: DataFrame) -> DataFrame:
    """Pages with a spec list -> one typed row each; gallery links in order, once."""
    spec = F.col("_spec")
    price = L.digits_int(F.regexp_extract("html", r"(?s)page-detail-top-title.*?<span>([^<]*₺[^<]*)</span>", 1))
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="(https://[^"]*_Buyuk\.jpg)"\s+data-fancybox="gallery"'), 1))
    title = F.regexp_replace(plain_text(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)), r"\s+", " ")
    of = lambda key: F.try_element_at(spec, F.lit(key))
    return pages.withColumn("_spec", spec_map(F.col("html"))).select(
        "page_id", F.nullif(title, F.lit("")).alias("title"), F.nullif(price, F.lit(0)).alias("price"), of("make").alias("make"), of("model").alias("model"),
        L.digits_int(of("year")).cast("int").alias("year"), L.digits_int(of("km")).alias("km"),
        F.lower(of("warranty")).isin("evet", "var").alias("warranty"), links.alias("image_urls"), F.size(links).alias("n_images"), spec.alias("spec"))


STATE = T.StructType([T.StructField("props", T.StructType([T.StructField("pageProps", T.StructType([T.StructField("assetDetails", T.StructType([
    T.StructField("mascusID", T.StringType()), T.StructField("country", T.StringType()), T.StructField("brand", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("meterReadoutKilometers", T.DoubleType()),
    T.StructField("priceOriginal", T.DoubleType()), T.StructField("priceOriginalUnit", T.StringType()),
    T.StructField("imagesSmallUrls", T.ArrayType(T.StringType()))]))]))]))])


def parse_state_pages(pages: DataFrame, countries: list[str]) -> DataFrame:
    """Pages with an embedded JSON state; the schema is the allow-list, so seller fields never appear."""
    blob = F.regexp_extract("html", r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    a = F.from_json(blob, STATE)["props"]["pageProps"]["assetDetails"]
    usable = F.filter(a["imagesSmallUrls"], lambda u: u.isNotNull() & (u != "") & ~u.contains("imagetilewm") & ~u.contains("no_pic"))
    full = F.transform(usable, lambda u: F.replace(F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https:"), u)), F.lit("/image/product/medium/"), F.lit("/image/product/large/")))
    rows = pages.withColumn("_a", a).where(F.upper("_a.country").isin(*countries))
    links = F.array_distinct(F.coalesce(full, F.array().cast("array<string>")))
    km, price = F.col("_a.meterReadoutKilometers"), F.col("_a.priceOriginal")
    return rows.select("page_id", F.col("_a.mascusID").alias("listing_id"), F.upper("_a.country").alias("market"), F.col("_a.brand").alias("make"), F.col("_a.model").alias("model"),
                       F.col("_a.year").alias("year"), F.when(km != 0, F.bround(km).cast("bigint")).alias("km"), F.when(price != 0, price).alias("price"),
                       F.col("_a.priceOriginalUnit").alias("currency"), links.alias("image_urls"), F.size(links).alias("n_images"))


RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("uvid", "vehicleType", "priceNet", "priceTotal", "dateOfRegistration", "km", "title")] + [T.StructField("sold", T.BooleanType())])


def parse_result_objects(rows: DataFrame, order: str) -> DataFrame:
    """Search results (JSON text ``result``) with the first rule that refuses each one.

    Only the first accepted row of an id counts; later ones are duplicates.
    """
    r = F.from_json("result", RESULT)
    price = L.digits_int(F.coalesce(F.nullif(F.col("r.priceNet"), F.lit("")), F.col("r.priceTotal")))
    year, km = L.first_year(F.col("r.dateOfRegistration")), L.digits_int(F.col("r.km"))
    base = rows.withColumn("r", r).withColumns({"price": price, "year": year, "km": km})
    bad = (F.when(F.coalesce(F.col("r.uvid"), F.lit("")) == "", "duplicate").when(F.coalesce(F.lower(F.trim("r.vehicleType")), F.lit("")) != "tractor units", "wrong_type")
           .when(F.coalesce(F.col("r.sold"), F.lit(False)), "sold").when(F.coalesce(F.col("price"), F.lit(0)) == 0, "no_price")
           .when((F.coalesce(F.col("year"), F.lit(0)) == 0) | (F.coalesce(F.col("km"), F.lit(0)) == 0), "no_year_or_km"))
    judged = base.withColumn("_bad", bad)
    first = judged.where("_bad is null").groupBy(F.col("r.uvid").alias("uvid")).agg(F.min(order).alias("_first"))
    out = judged.withColumn("uvid", F.col("r.uvid")).join(first, "uvid", "left")
    seen = F.col("_first").isNotNull() & (F.col(order) > F.col("_first"))
    return out.select(order, "uvid", "r.title", "price", "year", "km", F.when(seen, "duplicate").otherwise(F.col("_bad")).alias("skipped"))


ANSWER = T.StructType([
    T.StructField("legible", T.BooleanType()), T.StructField("confidence", T.StringType()), T.StructField("odometer_km", T.StringType()),
    T.StructField("strengths", T.ArrayType(T.StringType())),
    T.StructField("observations", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("component", "observation", "severity", "price_impact", "confidence")])))])


def json_body(text: Column) -> Column:
    """The outermost object of an answer, without code fences or text around it."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^\s*```(?:json)?\s*$|```(?:json)?", ""))
    return F.regexp_extract(plain, r"(?s)(\{.*\})", 1)


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), number)))


def parse_answers(responses: DataFrame, key: list[str]) -> DataFrame:
    """Landed answers with the parsed object; unreadable ones have ``parsed`` NULL."""
    parsed = F.from_json(json_body(F.col("response")), ANSWER, {"mode": "PERMISSIVE"})
    readable = F.try_parse_json(json_body(F.col("response"))).isNotNull()
    return responses.select(*key, F.when(readable, parsed).alias("parsed"))


def findings_of(answers: DataFrame, key: list[str]) -> DataFrame:
    """One row per observation. Every default rounds down and is marked ``ungraded``."""
    rows = answers.where("parsed is not null").select(*key, F.posexplode("parsed.observations").alias("pos", "o"))
    severity = F.when(F.col("o.severity").isin(*C.SEVERITIES), F.col("o.severity"))
    impact = F.when(F.col("o.price_impact").isin(*C.IMPACTS), F.col("o.price_impact"))
    text = F.trim(F.coalesce("o.observation", F.lit("")))
    return rows.where(text != "").select(
        *key, "pos", F.coalesce(F.nullif(F.trim("o.component"), F.lit("")), F.lit("other")).alias("component"), text.alias("observation"),
        F.coalesce(severity, F.lit("cosmetic")).alias("severity"), F.coalesce(impact, F.lit("none")).alias("price_impact"),
        clamped(F.col("o.confidence"), 0.0, 1.0, CONFIDENCE_UNREADABLE).alias("confidence"), (severity.isNull() | impact.isNull()).alias("ungraded"))


PANEL = T.StructType([
    T.StructField("components", T.MapType(T.StringType(), T.StructType([T.StructField("severity", T.StringType()), T.StructField("photos", T.ArrayType(T.IntegerType()))]))),
    T.StructField("grade", T.StringType()), T.StructField("grade_reason", T.StringType()), T.StructField("confidence", T.DoubleType())])


def panel_errors(answer: Column, n_photos: Column, components: list[str]) -> Column:
    """Every way a panel answer is unusable, named; an empty array is a clean answer."""
    known, states = F.array(*[F.lit(c) for c in components]), F.array(*[F.lit(s) for s in [*C.SEVERITIES, "not_visible"]])
    given = F.coalesce(F.map_keys(answer["components"]), F.array().cast("array<string>"))
    missing, unknown = F.array_except(known, given), F.array_except(given, known)
    entries = F.coalesce(F.map_entries(answer["components"]), F.array().cast("array<struct<key:string,value:struct<severity:string,photos:array<int>>>>"))
    bad_level = F.exists(entries, lambda e: ~F.coalesce(F.array_contains(states, e["value"]["severity"]), F.lit(False)))
    uncited = F.exists(entries, lambda e: F.coalesce(e["value"]["severity"].isin(*C.SEVERITIES), F.lit(False)) & (F.coalesce(F.size(e["value"]["photos"]), F.lit(0)) <= 0))
    outside = F.exists(entries, lambda e: F.exists(F.coalesce(e["value"]["photos"], F.array().cast("array<int>")), lambda p: (p < 0) | (p >= n_photos)))
    # ``when`` without a match is NULL, so a clean rule adds nothing.
    found = F.array(
        F.when(answer.isNull(), "not_json"), F.when(answer.isNotNull() & (F.size(missing) > 0), "components_missing"),
        F.when(F.size(unknown) > 0, "components_unknown"), F.when(bad_level, "severity_unknown"), F.when(uncited, "no_photo_cited"), F.when(outside, "photo_outside"),
        F.when(answer.isNotNull() & ~F.coalesce(answer["grade"].isin(*C.GRADES), F.lit(False)), "grade_unknown"),
        F.when(answer.isNotNull() & (F.coalesce(answer["grade_reason"], F.lit("")) == ""), "grade_reason_missing"),
        F.when(answer.isNotNull() & ~F.coalesce(answer["confidence"].between(0, 1), F.lit(False)), "confidence_outside"))
    return F.filter(found, lambda e: e.isNotNull())


def price_leaks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text reads as money, with the words that gave it away."""
    hit = F.regexp_extract(text, PRICE_WORDS, 1)
    return rows.where(F.col(text).rlike(PRICE_WORDS)).select(key, hit.alias("hit"))


# Keys of a reference card that no prompt reads.
UNREAD_KEYS = {"corpus", "basis", "sources", "aliases", "maintainer_note"}


def strings_of(node, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, string) of every string below ``node``, in document order, without what stands under unread keys."""
    open_ = [(path, node)]
    while open_:
        path, node = open_.pop()
        if isinstance(node, dict):
            open_ += [(f"{path}.{k}", v) for k, v in reversed(node.items()) if k not in UNREAD_KEYS]
        elif isinstance(node, list):
            open_ += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(node)))]
        elif isinstance(node, str):
            yield path, node


def card_leaks(cards: DataFrame, key: str, card: str) -> DataFrame:
    """(key, path, hit, excerpt): every string of a nested JSON card that reads as money, with the place it stands at.

    Of a card with ``models`` only these are walked. A card that is no JSON gives one row
    with a null path; a null card, and one without strings, gives none.
    """
    def walk(batches):
        words = re.compile(PRICE_WORDS)
        for batch in batches:
            out = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    read = json.loads(text)
                except ValueError:
                    out.append((own, None, "unreadable", text[:80]))
                    continue
                if isinstance(read, dict) and "models" in read:
                    read = read["models"]
                out += [(own, path, found.group(1), string[:80]) for path, string in strings_of(read) if (found := words.search(string))]
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), *[pa.array(c, pa.string()) for c in columns[1:]]], [key, "path", "hit", "excerpt"])

    shape = f"`{key}` {cards.schema[key].dataType.simpleString()}, path string, hit string, excerpt string"
    return cards.select(key, card).mapInArrow(walk, shape)
