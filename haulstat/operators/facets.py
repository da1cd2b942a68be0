"""Faceted counts: OR inside a group, AND across groups, one pass over the rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet_counts(rows: DataFrame, groups: dict[str, dict[str, Column]], chosen: dict[str, list[str]]) -> DataFrame:
    """Count per (group, option) under the current choice, zero counts kept.

    Every row gets a bit for each group whose choice it fails. An option counts
    a row that fails nothing, or fails only the option's own group.
    """
    bits = {g: 1 << i for i, g in enumerate(groups)}
    mask = F.lit(0)
    for g, options in groups.items():
        picked = [options[o] for o in chosen.get(g, [])]
        if picked:
            passes = picked[0]
            for p in picked[1:]:
                passes = passes | p
            mask = mask + F.when(F.coalesce(passes, F.lit(False)), 0).otherwise(bits[g])
    tagged = rows.withColumn("_mask", mask)
    sums = [F.count_if(((F.col("_mask") == 0) | (F.col("_mask") == bits[g])) & F.coalesce(cond, F.lit(False))).alias(f"{i}_{j}")
            for i, (g, options) in enumerate(groups.items()) for j, cond in enumerate(options.values())]
    row = tagged.agg(*sums)
    out = [F.struct(F.lit(g).alias("facet"), F.lit(o).alias("option"), F.col(f"{i}_{j}").alias("n"))
           for i, (g, options) in enumerate(groups.items()) for j, o in enumerate(options)]
    return row.select(F.inline(F.array(*out)))
