"""Residuals of every row under every replica (hold-out, split) without (rows x replicas) rows.

A replica prices a row by a line of its own. A task prices its rows for all replicas in numpy and hands on
histograms of the residuals, so what is shuffled grows with the tasks and the histograms' slots.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, small_table
from . import regression as G

STEP = 1e-4         # width of a slot: 0.01 % of a price
SLOTS = 4_000_000   # counters that a task keeps; residuals beyond its window are handed on one by one
CHUNK = 2048        # rows that are priced together


@dataclass
class Replicas:
    """Lines by (row key, replica), and which sides of the rows count in a replica.

    ``keys`` lists the values of the columns ``on``, ``sides`` those of the column ``side``. A line that is not there is NaN.
    """

    names: list[str]          # columns that tell replicas apart
    tags: list[tuple]         # their values
    on: list[str]
    keys: list[tuple]
    side: str
    sides: list
    const: np.ndarray         # (keys, replicas)
    slopes: np.ndarray        # (columns, keys, replicas)
    counts: np.ndarray        # (sides, replicas)
    fill: tuple[int, int, np.ndarray] | None = None  # (column, its missing flag, value by key and replica)


def replicas(fits: list, design: G.Design, categories: dict[str, list], names: list[str], side: str, sides: list, counts, fills=None) -> Replicas:
    """The lines of ``regression.line_table``, laid out by row key and replica.

    ``counts(side, tag)`` says whether a side's rows count in a replica. ``fills`` maps a replica's tag to the value of np_value where np_missing is 1.
    """
    columns, rows = G.line_rows(fits, design, categories)
    wide = len(design.dense)
    at = [columns.index(c) for c in names]
    on = [c for c in columns[:len(columns) - wide - 1] if c not in names]
    where = [columns.index(c) for c in on]
    tags = sorted({tuple(r[i] for i in at) for r in rows})
    keys = sorted({tuple(r[i] for i in where) for r in rows})
    tag_at, key_at = {v: i for i, v in enumerate(tags)}, {v: i for i, v in enumerate(keys)}
    const, slopes = np.full((len(keys), len(tags)), np.nan), np.zeros((wide, len(keys), len(tags)))
    for r in rows:
        k, j = key_at[tuple(r[i] for i in where)], tag_at[tuple(r[i] for i in at)]
        const[k, j], slopes[:, k, j] = r[-wide - 1], r[-wide:]
    taken = np.array([[bool(counts(s, tag)) for tag in tags] for s in sides]).reshape(len(sides), len(tags))
    fill = None
    if fills is not None:
        fill = (design.dense.index("np_value"), design.dense.index("np_missing"), np.tile([float(fills[tag]) for tag in tags], (len(keys), 1)))
    return Replicas(names, tags, on, keys, side, list(sides), const, slopes, taken, fill)


def coded(df: DataFrame, lines: Replicas, xs: list[str], y: str) -> DataFrame:
    """(_k, _s, y, columns...): the rows that have a line, with the places of their key and side."""
    keys = small_table(df.sparkSession, [(*k, i) for i, k in enumerate(lines.keys)], [*lines.on, "_k"])
    sides = small_table(df.sparkSession, list(zip(lines.sides, range(len(lines.sides)))), [lines.side, "_s"])
    numbers = [F.col(c).cast("double").alias(c) for c in [y, *xs]]
    return df.join(keys, lines.on).join(sides, lines.side).select("_k", "_s", *numbers)


def chunks(batches, lines: Replicas):
    """(residuals, which count) of a few rows by all replicas, one chunk after the other."""
    for batch in batches:
        k, s, y, *xs = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        for a in range(0, len(k), CHUNK):
            at = k[a:a + CHUNK]
            total = lines.const[at]
            for i, x in enumerate(xs):
                x = x[a:a + CHUNK, None]
                if lines.fill is not None and i == lines.fill[0]:
                    x = np.where(xs[lines.fill[1]][a:a + CHUNK, None] == 1, lines.fill[2][at], x)
                total = total + lines.slopes[i][at] * x
            resid = y[a:a + CHUNK, None] - total
            yield resid, lines.counts[s[a:a + CHUNK]] & ~np.isnan(resid)


def slots_of(resid: np.ndarray) -> np.ndarray:
    """Numbers of the slots: residuals over ``STEP``, rounded half away from zero as Spark's round does."""
    q = resid / STEP
    return np.trunc(q + np.copysign(0.5, q)).astype(np.int64)


def histograms(df: DataFrame, lines: Replicas, xs: list[str], y: str = "y") -> DataFrame:
    """(_r, _slot, _c): how many residuals of each replica fall in each slot, as a stored table."""
    n = len(lines.tags)
    half = max(1, min(32768, SLOTS // (2 * n)))

    def rows(r, slot, c):
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(slot, pa.int64()), pa.array(c, pa.int64())], ["_r", "_slot", "_c"])

    def run(batches):
        held = np.zeros(n * 2 * half, np.int64)
        for resid, counts in chunks(batches, lines):
            slot, r = slots_of(resid[counts]), np.nonzero(counts)[1]
            inside = (slot >= -half) & (slot < half)
            held += np.bincount(r[inside] * (2 * half) + slot[inside] + half, minlength=len(held))
            if not inside.all():
                yield rows(r[~inside], slot[~inside], np.ones(int((~inside).sum()), np.int64))
        full = np.nonzero(held)[0]
        yield rows(full // (2 * half), full % (2 * half) - half, held[full])

    parts = coded(df, lines, xs, y).mapInArrow(run, "_r int, _slot bigint, _c bigint")
    return cut_lineage(parts.groupBy("_r", "_slot").agg(F.sum("_c").alias("_c")))


def tagged(df: DataFrame, lines: Replicas) -> DataFrame:
    """The replicas' own columns instead of their number."""
    tags = small_table(df.sparkSession, [(*tag, i) for i, tag in enumerate(lines.tags)], [*lines.names, "_r"])
    return df.join(tags, "_r").drop("_r")


def rounded_percentiles(df: DataFrame, lines: Replicas, xs: list[str], probs: list[float], names: list[str], y: str = "y") -> DataFrame:
    """``regression.residual_percentiles`` of each replica's residuals: interpolated, residuals kept to ``STEP``."""
    spots = F.percentile((F.col("_slot").cast("double") * F.lit(STEP)), F.array(*[F.lit(float(p)) for p in probs]), F.col("_c"))
    out = histograms(df, lines, xs, y).groupBy("_r").agg(spots.alias("_p"))
    return tagged(out.select("_r", *[F.element_at("_p", i + 1).alias(name) for i, name in enumerate(names)]), lines)


def exact_percentiles(df: DataFrame, lines: Replicas, xs: list[str], probs: list[float], names: list[str], y: str = "y") -> DataFrame:
    """Interpolated percentiles of each replica's residuals as they are.

    Slots say where the wanted ranks lie; a second pass hands on the residuals of these slots only.
    """
    per_replica = W.partitionBy("_r")
    held = histograms(df, lines, xs, y).withColumn("_n", F.sum("_c").over(per_replica)).withColumn(
        "_before", F.sum("_c").over(per_replica.orderBy("_slot")) - F.col("_c"))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    wanted = (held.withColumn("_w", F.explode(ranks)).withColumn("_pos", F.col("_w.p") * (F.col("_n") - 1))
              .select("_r", "_slot", "_before", "_c", "_pos", F.col("_w.i").alias("_i"), F.posexplode(F.array(F.floor("_pos"), F.ceil("_pos"))).alias("_side", "_rank"))
              .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c"))).drop("_c"))
    wanted = cut_lineage(wanted)
    open_slots = [(r["_r"], r["_slot"]) for r in wanted.select("_r", "_slot").distinct().collect()]  # two for each replica and percentile at most
    of_replica = [np.array(sorted(s for r, s in open_slots if r == j), np.int64) for j in range(len(lines.tags))]

    def run(batches):
        for resid, counts in chunks(batches, lines):
            slot = slots_of(np.where(counts, resid, 0.0))
            for j, mine in enumerate(of_replica):
                at = counts[:, j] & np.isin(slot[:, j], mine)
                if at.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(at.sum()), j), pa.int32()), pa.array(slot[at, j]), pa.array(resid[at, j])], ["_r", "_slot", "_v"])

    values = coded(df, lines, xs, y).mapInArrow(run, "_r int, _slot bigint, _v double").groupBy("_r", "_slot", "_v").agg(F.count("*").alias("_c"))
    values = values.withColumn("_upto", F.sum("_c").over(W.partitionBy("_r", "_slot").orderBy("_v")))
    picked = values.join(wanted, ["_r", "_slot"]).where(
        (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_c")) & (F.col("_rank") < F.col("_before") + F.col("_upto")))
    share = F.col("_pos") - F.floor("_pos")
    ends = picked.groupBy("_r", "_i").agg(*[F.max(F.when(F.col("_side") == e, F.col("_v"))).alias(f"_v{e}") for e in (0, 1)], F.max(share).alias("_share"))
    value = F.col("_v0") * (1 - F.col("_share")) + F.col("_v1") * F.col("_share")
    out = ends.groupBy("_r").agg(*[F.max(F.when(F.col("_i") == i, value)).alias(name) for i, name in enumerate(names)])
    return tagged(out, lines)


def covered(df: DataFrame, lines: Replicas, xs: list[str], bands: dict[tuple, list[tuple[float, float]]], y: str = "y") -> DataFrame:
    """(replica's columns, n, hits_0, hits_1, ...): how many residuals of each replica lie in its bands, edges included."""
    n, levels = len(lines.tags), len(next(iter(bands.values()), []))
    edges = np.array([bands.get(tag, [(np.nan, np.nan)] * levels) for tag in lines.tags]).reshape(n, levels, 2)

    def run(batches):
        total = np.zeros((1 + levels, n), np.int64)
        for resid, counts in chunks(batches, lines):
            total[0] += counts.sum(axis=0)
            for i in range(levels):
                total[1 + i] += (counts & (resid >= edges[:, i, 0]) & (resid <= edges[:, i, 1])).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), *[pa.array(t) for t in total]], ["_r", "n", *[f"hits_{i}" for i in range(levels)]])

    shape = "_r int, n bigint" + "".join(f", hits_{i} bigint" for i in range(levels))
    sums = coded(df, lines, xs, y).mapInArrow(run, shape).groupBy("_r").agg(*[F.sum(c).alias(c) for c in ["n", *[f"hits_{i}" for i in range(levels)]]])
    return tagged(sums, lines)
