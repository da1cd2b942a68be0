"""Permutation nulls from one pass: no draw is ever shuffled, joined or written.

Rows meet once, in random blocks of their stratum of about ``BLOCK`` rows; a
block permutes its values in numpy for every draw and adds up the products the
statistic needs, so a task hands on sums only. Permuting inside random blocks is
an exact permutation test like any subgroup of the permutations, and its memory
does not grow with a stratum.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import draw_key, hash32

BLOCK = 4096
CHUNK = 256  # draws that are multiplied together


def multipliers(draws: int, block: int = BLOCK) -> list[int]:
    """The first ``draws`` primes above twice ``block``: without a common factor with any block's size.

    Sizes scatter around ``block``; twice that is out of their reach.
    """
    found: list[int] = []
    k = 2 * block + 1
    while len(found) < draws:
        if all(k % p for p in range(3, int(k ** 0.5) + 1, 2)):
            found.append(k)
        k += 2
    return found


def in_blocks(df: DataFrame, strata: list[str], row: str, seed: str, block: int = BLOCK) -> DataFrame:
    """``df`` with _s, its stratum's name, and _block, a random part of its stratum of about ``block`` rows.

    Sizes are counted per stratum (null is a value like any other) and joined back; Spark
    broadcasts them where their size allows, so a hot stratum stays where it is until it is cut.
    """
    keyed = df.withColumn("_s", F.to_json(F.struct(*[F.col(c).alias(f"s{i}") for i, c in enumerate(strata)])) if strata else F.lit(""))
    sizes = keyed.groupBy("_s").agg(F.ceil(F.count("*") / F.lit(block)).alias("_blocks"))
    out = keyed.join(sizes, "_s")
    return out.withColumn("_block", hash32(F.concat_ws("|", F.lit(f"{seed}-block"), F.col(row).cast("string"))) % F.col("_blocks")).drop("_blocks")


def permuted_sums(df: DataFrame, value: str, xs: list[str], row: str, draws: int, seed: str, strata: list[str] = (),
                  by: list[str] = (), squares: list[str] = (), block: int = BLOCK) -> DataFrame:
    """(by..., draw, term, value): sums over the rows of each ``by`` group for every draw, with ``value`` permuted inside ``strata``.

    Terms are ``1`` (the sum of the value), ``1^2`` (of its square), each x (of x times the
    value) and, for x in ``squares``, ``x^2`` (of x times its square). Draw 0 is the order as it is. In
    draw d the row at random place i of a block of m takes the value of the row at place
    (p_d * i + d) mod m in ``row`` order, p_d the d-th of ``multipliers``: every row's value is
    used once, and each draw is a uniform permutation. Rows whose value is null do not take part; a null x
    counts as 0. Rows that share a ``row`` key may change places. An empty table gives no rows.
    """
    strata, by, squares = list(strata), list(by), list(squares)
    blocks = in_blocks(df.where(F.col(value).isNotNull()), strata, row, seed, block)
    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in xs]).cast("array<double>")
    sent = blocks.select("_s", "_block", F.col(row).cast("string").alias("_row"), F.to_json(F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0))).alias("_by"),
                         F.col(value).cast("double").alias("_v"), numbers.alias("_x"))
    # The random order follows from the row's name, so it is not shuffled.
    sent = sent.repartition("_s", "_block").withColumn("_key", draw_key(seed, "_row")).sortWithinPartitions("_s", "_block", "_key", "_row", "_v").drop("_key")
    primes = np.array([1, *multipliers(draws, block)], np.int64)
    terms = ["1", *xs, "1^2", *[f"{c}^2" for c in squares]]
    squared = [0, *[1 + xs.index(c) for c in squares]]

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for names, groups, v, x in whole_blocks(batches, len(xs)):
            m = len(v)
            x = np.column_stack([np.ones(m), x])
            ordered = v[sorted(range(m), key=names.__getitem__)]
            codes, members = np.unique(groups, return_inverse=True)
            place = np.arange(m, dtype=np.int64)[:, None]
            for at in range(0, draws + 1, CHUNK):
                d = np.arange(at, min(at + CHUNK, draws + 1))
                picked = ordered[(place * primes[d] + d) % m]
                if at == 0:
                    picked[:, 0] = v
                cols = slice(at, at + len(d))
                for k, code in enumerate(codes):
                    mine = members == k if len(codes) > 1 else slice(None)
                    if code not in total:
                        total[code] = np.zeros((len(terms), draws + 1))
                    part = picked[mine]
                    total[code][:1 + len(xs), cols] += x[mine].T @ part
                    total[code][1 + len(xs):, cols] += x[mine][:, squared].T @ (part * part)
        for code, sums in total.items():
            n = sums.size
            yield pa.RecordBatch.from_arrays([pa.array([code] * n), pa.array(np.tile(np.arange(draws + 1), len(terms)), pa.int32()),
                                              pa.array([t for t in terms for _ in range(draws + 1)]), pa.array(sums.ravel())], ["_by", "draw", "term", "value"])

    parts = sent.mapInArrow(run, "_by string, draw int, term string, value double")
    sums = parts.groupBy("_by", "draw", "term").agg(F.sum("value").alias("value"))
    if not by:
        return sums.drop("_by")
    shape = T.StructType([df.schema[c] for c in by])
    return sums.withColumn("_k", F.from_json("_by", shape)).select(*[F.col(f"_k.{c}").alias(c) for c in by], "draw", "term", "value")


def whole_blocks(batches, width: int) -> Iterator[tuple]:
    """(row names, by groups, values, xs) of one block after the other, across the edges of batches."""
    held: list[tuple] = []
    key = None

    def done():
        names = [n for part in held for n in part[0]]
        return names, np.concatenate([p[1] for p in held]), np.concatenate([p[2] for p in held]), np.concatenate([p[3] for p in held])

    for batch in batches:
        strata, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names, groups = batch.column(2).to_pylist(), np.array(batch.column(3).to_pylist(), object).astype(str)
        v = batch.column(4).to_numpy(zero_copy_only=False)
        x = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(len(names), width)
        edges = [0] + [i for i in range(1, len(names)) if (strata[i], blocks[i]) != (strata[i - 1], blocks[i - 1])] + [len(names)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and key != (strata[a], blocks[a]):
                yield done()
                held = []
            key = strata[a], blocks[a]
            held.append((names[a:b], groups[a:b], v[a:b], x[a:b]))
    if held:
        yield done()


def exact_share(scores: list[float], observed: float) -> tuple[int, float]:
    """(how many reach the observed score, that share with the observed one counted in)."""
    reach = sum(1 for s in scores if s >= observed - 1e-9)
    return reach, (1 + reach) / (1 + len(scores))
