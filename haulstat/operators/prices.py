"""Price frame, new-price look-up, model application, verdicts."""
from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import listings as L
from ..functions.draws import fold_of

# Widening and floor constants of the estimate.
UNKNOWN_BRAND_WIDENING, MISSING_INPUT_WIDENING, MISSING_VIEW_WIDENING = 1.85, 1.60, 1.12
SOURCE_WIDENING = {"oem_official": 1.0, "trade_press": 1.35}
SALVAGE_FLOOR = {"TRY": 250000.0, "USD": 7500.0}


def price_frame(listings: DataFrame, folds: int = 5) -> DataFrame:
    """Priced adverts with features, log target, spec group and its fold."""
    c = F.col
    known = listings.where("price > 0 and year is not null and km is not null")
    brand = L.normal_brand(c("make"))
    norm = L.euro_norm(c("year"), c("euro_norm"))
    group = F.concat_ws("|", "market", brand, "model", c("size_class").cast("string"))
    out = known.withColumns({**L.feature_columns(c("year"), c("km")), "brand": brand, "spec_group": group,
                             "euro6": (norm == "Euro 6").cast("double"), "y": F.log("price")})
    return out.withColumn("fold", fold_of(c("spec_group"), folds))


def brand_vocabulary(frame: DataFrame, min_n: int = 5) -> DataFrame:
    """Makes with enough rows, one per row, with their counts."""
    return frame.groupBy("brand").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)


def new_price_lookup(listings: DataFrame, prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """New price of (brand, model): alias first, exact row, else the brand's default row.

    ``prices`` has brand, model, list_price, source_type, is_default; rows
    without a price are removed before matching. Only market TR has a table.
    """
    priced = prices.where("list_price > 0")
    folded = (listings.join(aliases.select("brand", F.col("alias").alias("model"), "canonical"), ["brand", "model"], "left")
              .withColumn("_wanted", F.coalesce("canonical", "model")))
    exact = priced.groupBy("brand", F.col("model").alias("_wanted")).agg(
        F.min_by(F.struct("list_price", "source_type"), "list_price").alias("_exact"))
    default = priced.where("is_default").groupBy("brand").agg(
        F.min_by(F.struct("list_price", "source_type"), "model").alias("_default"))
    joined = folded.join(exact, ["brand", "_wanted"], "left").join(default, "brand", "left")
    row = F.when(F.upper("market") == "TR", F.coalesce("_exact", "_default"))
    return (joined.withColumn("new_price", row["list_price"]).withColumn("new_price_source", row["source_type"])
            .withColumn("matched_by", F.when(row.isNull(), "none").when(F.col("_exact").isNotNull(), "exact").otherwise("default"))
            .drop("canonical", "_wanted", "_exact", "_default"))


def new_price_cell(value: Column, mean: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """(log new price, missing flag): imputed at the fit's mean, clipped to the fit's support."""
    return (F.when(value.isNull(), mean).otherwise(F.greatest(F.least(value, high), low)),
            F.when(value.isNull(), 1.0).otherwise(0.0))


@dataclass
class PriceModel:
    """A fitted model as stored: unknown fields are ignored, missing ones defaulted."""
    brands: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    coef: list[float] = field(default_factory=list)
    intercept: float = 0.0
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    residual_std: float = 0.1
    offsets: dict = field(default_factory=dict)
    calibration: dict = field(default_factory=dict)
    widening: dict = field(default_factory=dict)
    anchor: dict = field(default_factory=dict)
    new_price: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], ["value"]).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PriceModel":
        raw = json.loads(spark.read.text(path, wholetext=False).first()[0])
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in raw.items() if k in known})

    def mean_of(self, column: str, default: float) -> float:
        return self.mean[self.columns.index(column)] if column in self.columns else default


def term_columns(model: PriceModel) -> list[tuple[str, Column, Column]]:
    """(name, raw value, contribution) of every model column."""
    out = []
    for name, coef, mean, scale in zip(model.columns, model.coef, model.mean, model.scale):
        if name.startswith("brand_"):
            value = (F.col("brand_used") == name[len("brand_"):]).cast("double")
        elif name.startswith("market_"):
            value = (F.lower("market") == name[len("market_"):]).cast("double")
        else:
            value = F.col(name)
        out.append((name, value, (value - mean) / scale * coef))
    return out


def log_estimate(model: PriceModel) -> Column:
    total = F.lit(float(model.intercept))
    for _, _, part in term_columns(model):
        total = total + part
    return total


def contributions(model: PriceModel) -> Column:
    """Sorted array of the terms that move a prediction (zero make dummies left out)."""
    parts = [F.when((F.abs(part) >= 1e-6) & ~(F.lit(name.startswith("brand_")) & (value == 0)),
                    F.struct(F.round(-F.abs(part), 4).alias("order"), F.lit(name).alias("feature"),
                             F.round(part, 4).alias("effect"), F.round((F.exp(part) - 1) * 100, 1).alias("pct")))
             for name, value, part in term_columns(model)]
    return F.array_sort(F.filter(F.array(*parts), lambda x: x.isNotNull()))


def retention(anchor: dict, age: Column, log_km: Column) -> Column:
    (m1, m2), (s1, s2), (c1, c2) = anchor["mean"], anchor["scale"], anchor["coef"]
    return (age - m1) / s1 * c1 + (log_km - m2) / s2 * c2 + anchor["intercept"]


def blend(mu: Column, sd: Column, mu_other: Column, sd_other: Column) -> tuple[Column, Column, Column]:
    """Inverse-variance combination in log space: (mu, sd, weight of the other)."""
    w, v = 1 / F.pow(F.greatest(sd, F.lit(1e-6)), 2), 1 / F.pow(F.greatest(sd_other, F.lit(1e-6)), 2)
    return (w * mu + v * mu_other) / (w + v), F.sqrt(1 / (w + v)), v / (w + v)


def with_inputs(queries: DataFrame, model: PriceModel, this_year: int = L.REF_YEAR) -> DataFrame:
    """Missing year or distance falls back to the fleet-typical figure, and says so."""
    import math
    year0 = int(round(this_year - max(0.0, math.expm1(model.mean_of("log1p_age", math.log1p(5.0))))))
    km0 = int(round(math.exp(model.mean_of("log_km", math.log(300000)))))
    c = F.col
    out = (queries.withColumn("year_source", F.when(c("year").isNull(), "fleet_typical").otherwise("stated"))
           .withColumn("km_source", F.when(c("km").isNull(), "fleet_typical").otherwise("stated"))
           .withColumn("year", F.coalesce("year", F.lit(year0))).withColumn("km", F.coalesce("km", F.lit(float(km0)))))
    norm = L.euro_norm(c("year"), c("euro_norm"))
    known = F.array(*[F.lit(b) for b in model.brands])
    return (out.withColumns(L.feature_columns(c("year"), c("km")))
            .withColumn("brand", L.normal_brand(c("make")))
            .withColumn("brand_used", F.when(F.array_contains(known, c("brand")), c("brand")).otherwise("other"))
            .withColumn("euro6", (norm == "Euro 6").cast("double")))


def batch_estimate(queries: DataFrame, model: PriceModel, level: str = "0.8") -> DataFrame:
    """Point and both bands for every query row; a map over the rows, no shuffle.

    Optional columns: ``new_price`` and ``new_price_source`` (anchor route),
    ``multiplier`` and ``condition_widening``, ``extra_widening``.
    """
    c = F.col
    have = set(queries.columns)
    df = with_inputs(queries, model)
    unknown = ~F.array_contains(F.array(*[F.lit(b) for b in model.brands]), c("brand"))
    lo, hi = model.offsets[level]
    sd = F.lit(float(model.residual_std))
    factor = F.when(unknown, float(model.widening.get("unknown_brand", UNKNOWN_BRAND_WIDENING))).otherwise(1.0)
    mu = log_estimate(model)
    if model.anchor and "new_price" in have:
        known = c("new_price").isNotNull() & (F.upper("market") == "TR")
        source = F.coalesce(F.element_at(L.alias_map(SOURCE_WIDENING), c("new_price_source")), F.lit(1.35))
        point = F.bround(c("new_price") * F.bround(F.exp(retention(model.anchor, c("log1p_age"), c("log_km"))), 4), -3)
        both, joint, weight = blend(mu, sd * factor, F.log(point), F.lit(float(model.anchor["residual_std"])) * source)
        df = df.withColumn("anchor_weight", F.when(known, weight))
        mu = F.when(known, both).otherwise(mu)
        factor = F.when(known, F.greatest(F.lit(1.0), joint / sd)).otherwise(factor)
    missing = (c("year_source") == "fleet_typical").cast("int") + (c("km_source") == "fleet_typical").cast("int")
    factor = factor * F.pow(F.lit(MISSING_INPUT_WIDENING), missing)
    if "extra_widening" in have:
        factor = factor * c("extra_widening")
    adj = F.log("multiplier") if "multiplier" in have else F.lit(0.0)
    cond = c("condition_widening") if "condition_widening" in have else F.lit(1.0)
    currency = F.when(F.upper("market") == "TR", "TRY").otherwise("USD")
    df = df.withColumns({"_mu": mu, "_f": factor, "currency": currency}).withColumn(
        "_floor", F.element_at(F.create_map(*[F.lit(x) for kv in SALVAGE_FLOOR.items() for x in kv]), c("currency")))
    names = {"_p": F.exp(c("_mu") + adj), "_l": F.exp(c("_mu") + adj + lo * c("_f") * cond), "_h": F.exp(c("_mu") + adj + hi * c("_f") * cond),
             "_bp": F.exp("_mu"), "_bl": F.exp(c("_mu") + lo * c("_f")), "_bh": F.exp(c("_mu") + hi * c("_f"))}
    df = df.withColumns(names)
    point, low, high = salvage(c("_p"), c("_l"), c("_h"), c("_floor"))
    bpoint, blow, bhigh = salvage(c("_bp"), c("_bl"), c("_bh"), c("_floor"))
    out = df.withColumns({"point": F.bround(point, -3), "low": F.bround(low, -3), "high": F.bround(high, -3),
                          "baseline_point": F.bround(bpoint, -3), "baseline_low": F.bround(blow, -3),
                          "baseline_high": F.bround(bhigh, -3), "band_factor": c("_f"),
                          "floored": c("_p") < c("_floor")})
    return out.drop("_mu", "_f", "_floor", *names)


def salvage(point: Column, low: Column, high: Column, floor: Column) -> tuple[Column, Column, Column]:
    """A price under the salvage floor is lifted to it, with a band around it."""
    under = point < floor
    return (F.when(under, floor).otherwise(point),
            F.when(under, F.greatest(low, floor * 0.85)).otherwise(low),
            F.when(under, F.greatest(high, floor * 1.15)).otherwise(high))


def asking_verdict(asking: Column) -> dict[str, Column]:
    """Where an asking price sits against both bands."""
    c = F.col
    middle = (c("baseline_low") + c("baseline_high")) / 2
    inside = asking.between(c("baseline_low"), c("baseline_high"))
    return {"asking_rounded": F.bround(asking, -3),
            "vs_comparables_pct": F.round((asking / middle - 1) * 100, 1),
            "vs_estimate_pct": F.round((asking / c("point") - 1) * 100, 1),
            "inside_comparable_band": inside, "inside_estimate_band": asking.between(c("low"), c("high")),
            "label": F.when(inside, "in line with the market").when(asking > c("baseline_high"), "above the market")
            .otherwise("below the market")}
