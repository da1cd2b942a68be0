"""Draws, quotas, round robins, folds: all from hashes, none from driver state."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import draw_key, uniform
from .ranking import grouped_positions, with_row

# View priorities of the photo picks, forced views, corruption weights.
VIEW_PRIORITY = ["exterior_front_34", "tire_wheel", "dashboard_odometer", "exterior_side", "interior_cab",
                 "chassis_undercarriage", "fifth_wheel", "engine_bay", "damage_detail", "exterior_front", "exterior_rear"]
IDENTITY_PRIORITY = ["exterior_front_34", "exterior_side", "exterior_front", "exterior_rear"]
CORRUPTION_WEIGHTS = {
    "motion_blur": 1.0, "defocus": 0.7, "underexposed": 1.0, "overexposed": 0.6, "low_light_noise": 0.9,
    "sensor_noise": 0.6, "jpeg_crush": 1.0, "downscaled": 0.8, "awkward_angle": 1.0, "sun_glare": 0.5,
    "harsh_shadow": 0.5, "mud_spatter": 0.8, "rain": 0.3, "colour_cast": 0.7}


def priority_of(view: Column, order: list[str]) -> Column:
    """1-based place in a priority list; unlisted views follow all listed ones."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), view)
    return F.when(place == 0, len(order) + 1).otherwise(place)


def round_robin(df: DataFrame, unit: list[str], bucket: str, rank: Column, best: list[Column], limit: int) -> DataFrame:
    """One slot per bucket before any bucket gets a second, at most ``limit`` per unit.

    Nothing beyond ``limit`` inside one bucket can be picked, so the inner rank
    is limited first: Spark prunes each task before the shuffle and the outer
    window sees at most buckets x limit rows of a unit.
    """
    inner = W.partitionBy(*unit, bucket).orderBy(*best)
    short = df.withColumn("_turn", F.row_number().over(inner)).where(F.col("_turn") <= limit)
    outer = W.partitionBy(*unit).orderBy("_turn", rank, bucket)
    return (short.withColumn("slot", F.row_number().over(outer)).where(F.col("slot") <= limit).drop("_turn"))


def identity_round_robin(df: DataFrame, unit: list[str], best: list[Column], limit: int) -> DataFrame:
    """Whole-vehicle views first; a set without one falls back to the general order."""
    whole = F.col("view").isin(*IDENTITY_PRIORITY)
    rest = IDENTITY_PRIORITY + [v for v in VIEW_PRIORITY if v not in IDENTITY_PRIORITY]
    flags = df.groupBy(*unit).agg(F.bool_or(whole).alias("_whole"))
    rank = F.when(F.col("_whole"), priority_of(F.col("view"), rest)).otherwise(priority_of(F.col("view"), VIEW_PRIORITY))
    return round_robin(df.join(flags, unit), unit, "view", rank, best, limit).drop("_whole")


def allocate(strata: DataFrame, total: int, weight: str) -> DataFrame:
    """Largest-remainder quotas over a table of strata (one row each).

    The quotas add up to ``min(total, sum of weights)`` and no quota exceeds
    its stratum, because the wanted total never exceeds the pool.
    """
    pool = strata.agg(F.sum(weight).cast("bigint").alias("_pool"))
    sized = with_row(strata, pool, "_pool")
    want = F.least(F.lit(total), F.col("_pool"))
    exact = want * F.col(weight) / F.col("_pool")
    sized = sized.withColumn("_floor", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    given = sized.agg(F.sum("_floor").alias("_given"))
    names = [c for c in strata.columns if c != weight]
    ranked = grouped_positions(with_row(sized, given, "_given"), [], [F.col("_rest").desc(), *[F.col(n) for n in names]], "_at", "_all_n")
    extra = (F.col("_at") <= want - F.col("_given")).cast("bigint")
    return ranked.select(*strata.columns, (F.col("_floor") + extra).alias("quota"))


def draw_quota(df: DataFrame, strata: list[str], quotas: DataFrame, key: list[str], seed) -> DataFrame:
    """The first ``quota`` rows of every stratum in draw order."""
    drawn = df.withColumn("_draw", draw_key(seed, *key))
    ranked = grouped_positions(drawn, strata, [F.col("_draw"), *[F.col(k) for k in key]])
    return (ranked.join(quotas.select(*strata, "quota"), strata)
            .where(F.col("position") <= F.col("quota")).drop("_draw", "position", "group_size"))


def keep_share(df: DataFrame, unit: list[str], key: list[str], share: float, seed) -> DataFrame:
    """A share of every unit's rows, at least one."""
    drawn = df.withColumn("_draw", draw_key(seed, *key))
    ranked = grouped_positions(drawn, unit, [F.col("_draw"), *[F.col(k) for k in key]])
    return (ranked.where(F.col("position") <= F.greatest(F.lit(1), F.bround(F.col("group_size") * share)))
            .drop("_draw", "position", "group_size"))


def quota_with_cap(df: DataFrame, stratum: str, owner: str, key: list[str], total: int, cap: int,
                   top_up: list[Column], seed) -> DataFrame:
    """Proportional quota per stratum with a cap per owner, topped up to ``total``.

    The cap is applied first (so every later step keeps it), then the quotas,
    then the best of the rest.
    """
    drawn = df.withColumn("_draw", draw_key(seed, *key))
    sizes = drawn.groupBy(stratum).agg(F.count("*").alias("_n"))
    everyone = drawn.agg(F.count("*").alias("_all"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(total) * F.col("_n") / F.col("_all")))
    quotas = with_row(sizes, everyone, "_all").select(stratum, quota.alias("_quota"))
    capped = (drawn.withColumn("_at", F.row_number().over(W.partitionBy(owner).orderBy("_draw", *key)))
              .where(F.col("_at") <= cap).drop("_at"))
    ranked = grouped_positions(capped, [stratum], [F.col("_draw"), *[F.col(k) for k in key]], "_place", "_of")
    ranked = ranked.join(quotas, stratum).withColumn("by_quota", F.col("_place") <= F.col("_quota"))
    final = grouped_positions(ranked, [], [F.col("by_quota").desc(), *top_up, *[F.col(k) for k in key]], "_rank", "_size")
    return (final.where(F.col("by_quota") | (F.col("_rank") <= total))
            .drop("_draw", "_place", "_of", "_quota", "_rank", "_size"))


def spread(df: DataFrame, primary: str, secondary: str, key: list[str], n: int, seed) -> DataFrame:
    """Round robin over shuffled strata, taking each stratum's rarest secondary first."""
    drawn = df.withColumn("_draw", draw_key(seed, *key)).withColumn("_bucket", draw_key(seed, primary))
    inner = W.partitionBy(primary, secondary).orderBy("_draw", *key)
    drawn = drawn.withColumn("_round", F.row_number().over(inner)).where(F.col("_round") <= n)
    turn = W.partitionBy(primary).orderBy("_round", "_draw", *key)
    drawn = drawn.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= n)
    return drawn.orderBy("_turn", "_bucket", primary).limit(n).drop("_draw", "_bucket", "_round", "_turn")


def weighted_draw(df: DataFrame, key: list[str], weights: dict[str, float], seed, sizes=((0.4, 2), (0.8, 3), (1.0, 4)),
                  never_with: tuple[str, str] = ("underexposed", "overexposed")) -> DataFrame:
    """Weighted draw without replacement of a few names per row, sorted, as ``chosen``.

    Efraimidis-Spirakis: the k smallest of -ln(u)/weight. The names are a fixed
    short list, so the draw stays inside the row. Of the pair ``never_with`` the
    second is dropped when both were drawn.
    """
    u = uniform(f"{seed}#k", *key)
    count = F.when(u <= sizes[0][0], sizes[0][1])
    for upto, k in sizes[1:]:
        count = count.when(u <= upto, k)
    races = F.array(*[F.struct((-F.log(uniform(f"{seed}#{name}", *key)) / F.lit(w)).alias("t"), F.lit(name).alias("name"))
                      for name, w in weights.items()])
    drawn = F.transform(F.slice(F.array_sort(races), 1, count), lambda r: r["name"])
    keep, drop = never_with
    clash = F.array_contains("_drawn", keep) & F.array_contains("_drawn", drop)
    return (df.withColumn("_drawn", drawn)
            .withColumn("chosen", F.array_sort(F.when(clash, F.array_remove("_drawn", drop)).otherwise(F.col("_drawn"))))
            .drop("_drawn"))


def triangular(u: Column, low: float, mode: float, high: float) -> Column:
    """Inverse of the triangular distribution."""
    knee = (mode - low) / (high - low)
    left = low + F.sqrt(u * (high - low) * (mode - low))
    right = high - F.sqrt((1 - u) * (high - low) * (high - mode))
    return F.when(u < knee, left).otherwise(right)
