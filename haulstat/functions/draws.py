"""Draws that depend only on (seed, key): the same on any partitioning."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 4294967296  # 2**32, eight hex digits


def draw_key(seed, *keys) -> Column:
    """Hex string that orders rows at random but repeatably."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *keys) -> Column:
    """Uniform on (0, 1]: never zero, so its logarithm exists."""
    head = F.conv(F.substring(draw_key(seed, *keys), 1, 8), 16, 10).cast("double")
    return (head + 1) / F.lit(float(HASH_SPACE))


def fold_of(group: Column, k: int) -> Column:
    """Fold number of a group; every row of the group lands in one fold."""
    return F.pmod(hash32(group), F.lit(k)).cast("int")
