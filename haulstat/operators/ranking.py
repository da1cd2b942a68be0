"""Ranks and order statistics that never put one whole group into one task."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def with_row(df: DataFrame, row: DataFrame, *columns: str) -> DataFrame:
    """Attach the columns of a one-row frame through one scalar subquery."""
    packed = row.select(F.struct(*columns).alias("packed")).scalar()
    out = df.withColumn("_row", packed)
    return out.withColumns({c: F.col(f"_row.{c}") for c in columns}).drop("_row")


def grouped_positions(df: DataFrame, by: list[str], order: list[Column],
                      position: str = "position", size: str = "group_size") -> DataFrame:
    """1-based position in ``order`` inside each ``by`` group, plus the group size.

    For few, huge groups. A range shuffle sorts the rows across tasks, the
    sorted slices are written once, and each slice needs only its row count
    from the others. ``order`` must be total (end it with a unique key).
    """
    spread = [F.col(c) for c in by] + list(order)
    sliced = (df.repartitionByRange(*spread).sortWithinPartitions(*spread)
              .withColumn("_gp_at", F.monotonically_increasing_id()))
    sliced = cut_lineage(sliced).withColumn("_gp_slice", F.shiftright("_gp_at", ROW_BITS))
    keys = by or ["_gp_all"]
    if not by:
        sliced = sliced.withColumn("_gp_all", F.lit(0))
    runs = sliced.groupBy(*keys, "_gp_slice").agg(F.min("_gp_at").alias("_gp_first"), F.count("*").alias("_gp_n"))
    per_group = W.partitionBy(*keys)
    runs = (runs
            .withColumn("_gp_before", F.sum("_gp_n").over(per_group.orderBy("_gp_slice")) - F.col("_gp_n"))
            .withColumn(size, F.sum("_gp_n").over(per_group))
            .drop("_gp_n"))
    out = sliced.join(runs, keys + ["_gp_slice"] if by else ["_gp_slice"])
    out = out.withColumn(position, F.col("_gp_at") - F.col("_gp_first") + F.col("_gp_before") + 1)
    return out.drop("_gp_at", "_gp_slice", "_gp_first", "_gp_before", "_gp_all")


def exact_percentiles(df: DataFrame, by: list[str], value: str, probs: list[float],
                      names: list[str], buckets: int = 128, direct_limit: int = 500_000) -> DataFrame:
    """Exact interpolated percentiles, one row per ``by`` group (columns ``names`` and ``n``).

    Equal values are counted first and the counts are written once. While no
    group has more than ``direct_limit`` distinct values the built-in weighted
    percentile reads them. Beyond it approximate quantiles split the distinct
    values into buckets, bucket counts say which buckets hold the wanted
    ranks, and only those buckets are sorted. Both ways are exact.
    """
    keys = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    counted = (src.where(F.col(value).isNotNull())
               .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")))
    counted = cut_lineage(counted)
    widest = counted.groupBy(*keys).agg(F.count("*").alias("_d")).agg(F.max("_d")).first()[0]
    if (widest or 0) <= direct_limit:
        spots = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]), F.col("_c"))
        out = counted.groupBy(*keys).agg(F.sum("_c").alias("n"), spots.alias("_p")).select(
            *keys, "n", *[F.element_at("_p", i + 1).alias(name) for i, name in enumerate(names)])
        return out if by else out.drop("_all")
    cut_points = [i / buckets for i in range(1, buckets)]
    step = max(2, int(buckets ** 0.5))
    cuts = counted.groupBy(*keys).agg(F.percentile_approx("_v", cut_points, 10 * buckets).alias("_cuts"))
    cuts = cuts.withColumn("_rough", F.filter("_cuts", lambda c, i: i % step == step - 1))
    tagged = counted.join(cuts, keys) if by else with_row(counted, cuts, "_cuts", "_rough")
    # Two short searches (every ``step``-th cut, then the cuts between) instead of one long one.
    start = F.size(F.filter("_rough", lambda c: c < F.col("_v"))) * step
    tagged = (tagged.withColumn("_start", start)
              .withColumn("_b", F.col("_start") + F.size(F.filter(F.slice("_cuts", F.col("_start") + 1, F.lit(step)), lambda c: c < F.col("_v"))))
              .drop("_cuts", "_rough", "_start"))
    held = tagged.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bn"))
    per_group = W.partitionBy(*keys)
    held = (held.withColumn("_start", F.sum("_bn").over(per_group.orderBy("_b")) - F.col("_bn"))
            .withColumn("n", F.sum("_bn").over(per_group)))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                      for i, p in enumerate(probs)])
    wanted = (held.withColumn("_w", F.explode(ranks))
              .withColumn("_pos", F.col("_w.p") * (F.col("n") - 1))
              .withColumn("_end", F.array(F.floor("_pos"), F.ceil("_pos")))
              .select(*keys, "_b", "_start", "_bn", "n", F.col("_w.i").alias("_i"), "_pos",
                      F.posexplode("_end").alias("_side", "_k"))
              .where((F.col("_k") >= F.col("_start")) & (F.col("_k") < F.col("_start") + F.col("_bn"))))
    in_bucket = W.partitionBy(*keys, "_b").orderBy("_v")
    needed = wanted.select(*keys, "_b", "_start").distinct()
    running = (tagged.join(needed, keys + ["_b"])
               .withColumn("_hi", F.sum("_c").over(in_bucket) + F.col("_start"))
               .withColumn("_lo", F.col("_hi") - F.col("_c"))
               .drop("_start", "_c"))
    picked = (running.join(wanted.drop("_start", "_bn"), keys + ["_b"])
              .where((F.col("_k") >= F.col("_lo")) & (F.col("_k") < F.col("_hi"))))
    at = {}
    for i in range(len(probs)):
        for side in (0, 1):
            at[i, side] = F.max(F.when((F.col("_i") == i) & (F.col("_side") == side), F.col("_v")))
    frac = [F.max(F.when(F.col("_i") == i, F.col("_pos") - F.floor("_pos"))) for i in range(len(probs))]
    out = picked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[(at[i, 0] + (at[i, 1] - at[i, 0]) * frac[i]).alias(name) for i, name in enumerate(names)])
    return out if by else out.drop("_all")


def rank_with_ties(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Average-tie rank of ``value`` inside ``by`` (NULL stays NULL).

    Ranks are computed over distinct values, so a value shared by many rows
    costs one row; the running count is taken slice by slice.
    """
    keys = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    counted = src.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = running_total(counted, keys, [F.col(value)], "_c", "_upto")
    # Stored, so that Spark knows the size of the ranks and sends few of them to the rows.
    ranked = cut_lineage(ranked.select(*keys, value, (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(name),
                                       (F.col("_upto") - F.col("_c") + 1).alias(f"{name}_low")))
    return src.join(ranked, keys + [value], "left").drop("_all")


def running_total(df: DataFrame, by: list[str], order: list[Column], amount: str, name: str) -> DataFrame:
    """Inclusive running sum of ``amount`` along ``order`` inside ``by``, slice by slice."""
    spread = [F.col(c) for c in by] + list(order)
    sliced = cut_lineage(df.repartitionByRange(*spread).sortWithinPartitions(*spread)
                         .withColumn("_slice", F.spark_partition_id()))
    sums = sliced.groupBy(*by, "_slice").agg(F.sum(amount).alias("_s"))
    sums = sums.withColumn("_before", F.sum("_s").over(W.partitionBy(*by).orderBy("_slice")) - F.col("_s"))
    inside = W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (sliced.join(sums.drop("_s"), by + ["_slice"])
            .withColumn(name, F.sum(amount).over(inside) + F.col("_before"))
            .drop("_slice", "_before"))


def first_true(reasons: list[tuple[Column, str]]) -> Column:
    """The label of the first condition that holds, else NULL."""
    return reduce(lambda acc, pair: acc.when(pair[0], pair[1]), reasons[1:],
                  F.when(reasons[0][0], reasons[0][1]))
