"""Keyed stores: embeddings that are computed once, answers that are paid for once."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed_missing(items: DataFrame, stored: DataFrame, key: str, content: str, embed) -> DataFrame:
    """Embed the items whose key is not stored; ``embed(list) -> (n, d)`` runs per Arrow batch."""
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(embed(v.tolist()), dtype=float)))

    return items.join(stored.select(key), key, "left_anti").withColumn("emb", run(F.col(content)))


def response_key(fields: dict[str, Column]) -> Column:
    """SHA-256 over labelled, length-prefixed fields: no two inputs run together."""
    parts = []
    for label, value in fields.items():
        text = F.coalesce(value.cast("string"), F.lit(""))
        parts += [F.lit(f"{label}:"), F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";")]
    return F.sha2(F.concat(*parts), 256)


def resolve_planned(planned: DataFrame, answered: DataFrame, by: list[str]) -> DataFrame:
    """Per group: planned calls, already answered, and the distinct calls still to pay for."""
    keys = answered.select("key").distinct().withColumn("_have", F.lit(1))
    per_key = planned.groupBy(*by, "key").agg(F.count("*").alias("_n")).join(keys, "key", "left")
    have = F.col("_have").isNotNull()
    return per_key.groupBy(*by).agg(F.sum("_n").alias("planned"), F.sum(F.when(have, F.col("_n")).otherwise(0)).alias("answered"),
                                    F.count_if(~have).alias("to_pay"))
