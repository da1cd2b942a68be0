"""Column rules for adverts: numbers, money, makes, norms, bands."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.ranking import first_true

# Exchange rate, reference year, floors, norm steps, band edges, spellings.
USD_TRY = 48.596
REF_YEAR = 2026
KM_FLOOR = 1000.0
KM_PER_MILE = 1.609344
EURO_NORM_BY_YEAR = ((2016, "Euro 6"), (2009, "Euro 5"), (2006, "Euro 4"))
EURO_NORM_OLDEST = "Euro 3"
KM_PER_YEAR = (48981, 61901, 71267)
BRAND_ALIASES = {
    "FORD TRUCKS": "FORD", "FORD TRUCK": "FORD",
    "MERCEDES": "MERCEDES-BENZ", "MERCEDES BENZ": "MERCEDES-BENZ",
    "WESTERN STAR": "WESTERNSTAR", "INTERNATIONAL HARVESTER": "INTERNATIONAL",
}


def alias_map(aliases: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])


def digits_int(value: Column) -> Column:
    """All digits of a text as one integer; no digit gives NULL."""
    return F.regexp_replace(value, "[^0-9]", "").try_cast("bigint")


def first_year(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def miles_to_km(miles: Column, constant: float = KM_PER_MILE) -> Column:
    return F.bround(miles * F.lit(constant), 0)


def price_usd(price: Column, currency: Column, usd_try: float = USD_TRY) -> Column:
    """Price in USD; zero or missing price and unknown currencies give NULL."""
    dollars = currency.isNull() | currency.isin("USD", "$")
    lira = currency.isin("TRY", "TL", "₺")
    return F.when(price.isNull() | (price == 0), None).when(dollars, F.bround(price, 2)).when(
        lira, F.bround(price / F.lit(usd_try), 2))


def normal_brand(make: Column) -> Column:
    folded = F.upper(F.trim(make))
    named = F.coalesce(F.element_at(alias_map(BRAND_ALIASES), folded), folded)
    return F.when(make.isNull() | (make == ""), "other").otherwise(named)


def euro_norm(year: Column, stated: Column) -> Column:
    steps = [(year >= cut, norm) for cut, norm in EURO_NORM_BY_YEAR]
    by_year = F.when(year.isNull() | (year == 0), None).otherwise(
        first_true(steps).otherwise(EURO_NORM_OLDEST))
    return F.coalesce(F.nullif(stated, F.lit("")), by_year)


def feature_columns(year: Column, km: Column) -> dict[str, Column]:
    return {"log1p_age": F.log1p(F.greatest(F.lit(REF_YEAR) - year, F.lit(0)).cast("double")),
            "log_km": F.log(F.greatest(km, F.lit(KM_FLOOR)))}


def spec_group(market: Column, brand: Column, model: Column, year: Column, price: Column) -> Column:
    """Adverts of one batch share this key, so no fold can separate them."""
    return F.concat_ws("|", market, brand, model, year.cast("string"),
                       price.cast("decimal(18,2)").cast("string"))


def wear_band(km: Column, edges: list[tuple[float | None, str]]) -> Column:
    steps = [(F.lit(True) if top is None else km < top, name) for top, name in edges]
    return F.when(km.isNull() | (km <= 0), None).otherwise(first_true(steps))


def km_band_low(km: Column) -> Column:
    """Lower edge of the coarse band that hides the exact distance."""
    width = F.when(km < 500000, 100000).otherwise(250000)
    return (F.floor(km / width) * width).cast("bigint")


def km_band_high(km: Column) -> Column:
    return km_band_low(km) + F.when(km < 500000, 100000).otherwise(250000)


def usage_verdict(age: Column, km: Column, quartiles=KM_PER_YEAR) -> Column:
    """Worked more or less than trucks of this age usually have."""
    low = F.bround(age * F.lit(quartiles[0]), -4)
    high = F.bround(age * F.lit(quartiles[2]), -4)
    return (F.when(km.isNull(), "unstated").when((age <= 0) | (high <= 0), "no_basis")
            .when(km > high, "worked_more").when(km < low, "worked_less").otherwise("as_expected"))


def pretty_make(raw: Column, fixups: dict[str, str]) -> Column:
    name = F.trim(raw)
    blank = name.isNull() | (name == "") | F.lower(name).isin("nan", "none", "null")
    return F.when(blank, "Unknown").otherwise(
        F.coalesce(F.element_at(alias_map(fixups), F.upper(name)), F.initcap(name)))


def home_market(market: Column, source_key: Column) -> Column:
    folded = F.upper(F.trim(market))
    return F.when(folded.isin("TR", "US"), folded).when(
        F.coalesce(source_key, F.lit("")).startswith("tr_"), "TR").otherwise("US")


def split_title(title: Column, makes: list[str], canonical: dict[str, str]) -> tuple[Column, Column]:
    """(make, model) of a title: the longest known prefix, else the first word."""
    clean = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    first, rest = F.substring_index(clean, " ", 1), F.regexp_replace(clean, r"^\S+\s*", "")
    make, model = F.upper(first), F.when(rest == "", clean).otherwise(rest)
    for known in sorted(makes, key=len):
        hit = F.lower(clean).startswith(known.lower())
        tail = F.regexp_replace(F.substring(clean, len(known) + 1, 1 << 30), r"^[ -]+|[ -]+$", "")
        make = F.when(hit, canonical.get(known, known).upper()).otherwise(make)
        model = F.when(hit, F.when(tail == "", clean).otherwise(tail)).otherwise(model)
    return make, model


def fold_text(text: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")
