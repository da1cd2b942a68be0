"""Whitening of embeddings from exact bit-sliced cross-products.

Entries become integers. Each block of distinct vectors is shifted to start at
zero in every dimension and packed bit plane by bit plane, 64 rows to a word,
so that the AND of two planes and a popcount count the rows which have both
bits set; weighted by their powers of two these counts are the exact
cross-products. Blocks add up as whole numbers in Spark, the scatter is centred
as a whole number on the driver (dimensions x dimensions, never rows), and only
then turned into doubles for ``eigh``.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LIMIT = 2.0 ** 62  # entries whose scaled value lies beyond are taken as this value
BLOCK = 4096  # rows whose planes are counted together
WIDTHS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


def vectors_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their entries as a float64 matrix) for each length; rows with a null or non-finite entry are left out."""
    lists = column if isinstance(column, pa.ListArray) else column.cast(pa.list_(column.type.value_type))
    values = lists.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # a null entry is read as NaN
    offsets = lists.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    there = np.ones(len(lists), bool) if not lists.null_count else np.asarray(lists.is_valid().to_pylist(), bool)
    out = []
    for size in np.unique(lengths[there]).tolist():
        rows = np.flatnonzero(there & (lengths == size))
        matrix = flat[offsets[rows][:, None] + np.arange(size)] if size else np.zeros((len(rows), 0))
        fine = np.isfinite(matrix).all(axis=1)
        out.append((rows[fine], matrix[fine]))
    return out


def steps(matrix: np.ndarray) -> np.ndarray:
    """floor(64 c), the part of x that differs from the shift; beyond +-2^62 it stops there."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(matrix * SCALE), -LIMIT, LIMIT).astype(np.int64)


def packed(whole: np.ndarray) -> list[bytes]:
    """One name per row: the narrowest width in bytes, then the entries; equal vectors have equal names."""
    low, high = whole.min(axis=1, initial=0), whole.max(axis=1, initial=0)
    out: list = [b"\x01"] * len(whole)
    left = np.ones(len(whole), bool)
    for width, kind in WIDTHS.items():
        edge = np.iinfo(kind)
        rows = np.flatnonzero(left & (low >= edge.min) & (high <= edge.max))
        left[rows] = False
        for k, row in zip(rows.tolist(), np.ascontiguousarray(whole[rows].astype(kind))):
            out[k] = bytes([width]) + row.tobytes()
    return out


def unpacked(names: list[bytes], dims: int) -> np.ndarray:
    """The rows of ``packed`` names as an int64 matrix of ``dims`` columns, zeros where a vector is shorter."""
    out = np.zeros((len(names), dims), np.int64)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, name in enumerate(names):
        alike.setdefault((name[0], len(name)), []).append(k)
    for (width, length), rows in alike.items():
        block = np.frombuffer(b"".join(names[k][1:] for k in rows), WIDTHS[width]).reshape(len(rows), (length - 1) // width)
        out[rows, :block.shape[1]] = block
    return out


def cross_products(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums per dimension, sums of products of two dimensions) of an int64 matrix, exact, from its bit planes.

    The result is int64 where every step fits and Python integers elsewhere.
    """
    rows, dims = whole.shape
    low = whole.min(axis=0)
    shifted = whole.astype(np.uint64) - low.astype(np.uint64)  # modulo 2^64, so exact for any two longs
    bits = [int(b).bit_length() for b in shifted.max(axis=0).tolist()]
    first = np.concatenate([[0], np.cumsum(bits)])
    words = -(-rows // 64)
    planes = np.zeros((int(first[-1]), words * 8), np.uint8)
    for i, many in enumerate(bits):
        for b in range(many):
            line = np.packbits((shifted[:, i] >> np.uint64(b)).astype(np.uint8) & 1)
            planes[first[i] + b, :len(line)] = line
    planes = planes.view(np.uint64)
    counts = np.zeros((len(planes), len(planes)), np.int64)
    for p in range(len(planes)):
        counts[p, p:] = counts[p:, p] = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
    most = max([int(abs(int(v))) for v in low.tolist()] + [0]) + (1 << max(bits, default=0))
    kind = np.int64 if 4 * rows * most * most < 1 << 62 else object
    weights = np.array([1 << b for many in bits for b in range(many)], kind)
    used = [i for i, many in enumerate(bits) if many]
    sums, cross = np.zeros(dims, kind), np.zeros((dims, dims), kind)
    if used:
        at = first[used]
        scaled = counts.astype(kind) * weights[:, None] * weights[None, :]
        cross[np.ix_(used, used)] = np.add.reduceat(np.add.reduceat(scaled, at, axis=0), at, axis=1)
        sums[used] = np.add.reduceat(np.diagonal(counts).astype(kind) * weights, at)
    base = low.astype(kind)
    lifted = cross + np.outer(base, sums) + np.outer(sums, base) + rows * np.outer(base, base)
    return sums + rows * base, lifted


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: sizes and sums of the fit list and the components of its covariance."""

    n: int
    sums: tuple[int, ...]
    values: tuple[float, ...]  # eigenvalues, falling
    vectors: np.ndarray  # a column for each component
    explained: tuple[float, ...]

    @property
    def scaled(self) -> np.ndarray:
        """Columns over the root of their eigenvalue; NaN where the eigenvalue is zero."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.array(self.values) > 0, self.vectors / np.sqrt(self.values), np.nan)

    def centred(self, whole: np.ndarray) -> np.ndarray:
        """n*x - S, whole numbers."""
        sums = np.array(self.sums, object)
        shifted = sums - self.n * SHIFT  # entries are kept without the shift
        most = self.n * int(max(abs(int(whole.min(initial=0))), abs(int(whole.max(initial=0))))) + max([abs(int(s)) for s in shifted], default=0)
        if most < 1 << 62:
            return whole * self.n - shifted.astype(np.int64)
        return whole.astype(object) * self.n - shifted

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.scaled


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(name): each integer vector once, packed. Equal rows meet before the shuffle, so a common vector costs a row a task."""
    def names(batches):
        for batch in batches:
            for _, matrix in vectors_of(batch.column(0)):
                if len(matrix):
                    yield pa.RecordBatch.from_arrays([pa.array(packed(steps(matrix)), pa.binary())], ["name"])

    return rows.select("embedding").mapInArrow(names, "name binary").distinct()


def decoded(batches):
    """Matrices of at most ``BLOCK`` rows from batches of names, as wide as their longest vector."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        for at in range(0, len(names), BLOCK):
            piece = names[at:at + BLOCK]
            yield unpacked(piece, max((len(x) - 1) // x[0] for x in piece))


def scatter(distinct: DataFrame) -> tuple[int, int, dict[tuple[int, int], int]]:
    """(rows, dimensions, exact sums): (i, j) of products, (i, -1) of entries. One row per pair of dimensions comes back."""
    def partial(batches):
        rows, sums, cross = 0, np.zeros(0, object), np.zeros((0, 0), object)
        for whole in decoded(batches):
            rows += len(whole)
            dims = whole.shape[1]
            if dims > len(sums):
                sums = np.concatenate([sums, np.zeros(dims - len(sums), object)])
                grown = np.zeros((dims, dims), object)
                grown[:len(cross), :len(cross)] = cross
                cross = grown
            if dims:
                s, c = cross_products(whole)
                sums[:dims] += s
                cross[:dims, :dims] += c
        out = [(-1, -1, rows)] if rows else []
        for i in range(len(sums)):
            out.append((i, -1, sums[i]))
            out += [(i, j, cross[i, j]) for j in range(i, len(sums))]
        for at in range(0, len(out), 10_000):
            i, j, value = zip(*out[at:at + 10_000])
            high = [Decimal(int(v) >> 62) for v in value]  # two parts, so that no sum outgrows a decimal
            low = [int(v) & (1 << 62) - 1 for v in value]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(high, pa.decimal128(38, 0)), pa.array(low, pa.int64())],
                                             ["i", "j", "high", "low"])

    parts = distinct.mapInArrow(partial, "i int, j int, high decimal(38,0), low long")
    sums = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    got = {(r.i, r.j): (int(r.high) << 62) + int(r.low) for r in sums}
    rows = got.pop((-1, -1), 0)
    return rows, 1 + max([i for i, _ in got], default=-1), got


def fit_whitening(distinct: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of the covariance of the distinct vectors, from exact centred sums.

    ``n * sum(x y) - S_x S_y`` is a whole number; it is divided by n * n once, correctly
    rounded. Of each vector the entry of the largest size is positive. An eigenvalue that is
    zero up to rounding counts as zero.
    """
    n, dims, got = scatter(distinct)
    plain = [got.get((i, -1), 0) for i in range(dims)]
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            centred = n * got.get((i, j), 0) - plain[i] * plain[j]
            covariance[i, j] = covariance[j, i] = centred / (n * n)
    values, vectors = np.linalg.eigh(covariance) if dims else (np.zeros(0), np.zeros((0, 0)))
    keep = min(components, dims)
    values, vectors = values[::-1][:keep], vectors[:, ::-1][:, :keep]
    floor = dims * np.finfo(float).eps * max(values[:1].tolist() + [0.0])
    values = np.where(values > floor, values, 0.0)
    if keep:
        top = np.argmax(np.abs(vectors), axis=0)
        vectors = vectors * np.where(vectors[top, np.arange(keep)] < 0, -1.0, 1.0)
    trace = math.fsum(np.diagonal(covariance).tolist())
    explained = tuple(float(v / trace) if trace > 0 else 0.0 for v in values)
    return Whitening(n, tuple(p + n * SHIFT for p in plain), tuple(values.tolist()), vectors, explained)


def identity_error(distinct: DataFrame, fit: Whitening) -> float:
    """Largest distance of the whitened fit list's covariance from the identity, measured on the rows themselves."""
    live = [k for k, v in enumerate(fit.values) if v > 0]
    if not live:
        return 0.0
    dims = len(fit.sums)

    def partial(batches):
        total = np.zeros((len(live), len(live)))
        for batch in batches:
            names = batch.column(0).to_pylist()
            white = fit.whitened(fit.centred(unpacked(names, dims)))[:, live]
            total += white.T @ white
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(live, len(live)), pa.int32()), pa.array(np.tile(live, len(live)), pa.int32()), pa.array(total.ravel())],
                                         ["i", "j", "value"])

    parts = distinct.mapInArrow(partial, "i int, j int, value double")
    sums = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    return max(abs(r.value / fit.n - (r.i == r.j)) for r in sums)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening, float]:
    """(vectors, fit, identity error) for ``rows`` with vec_id and an array column embedding; other columns are not read.

    The vectors have vec_id, deviation decimal(38,0) (the exact sum of (n*x - S)^2)
    and whitened array<double>, one entry for each component, falling by eigenvalue.

    A null vector, and one with a null or non-finite entry, is dropped. A vector that is
    shorter than the longest is one of its own in the fit list and has zeros at its end, an empty one is all zeros. A null id and
    repeated rows stay, every row with its own result; equal vectors count once in the fit.
    Scaled entries beyond +-2^62 count as that value; a deviation that has more than 38 digits
    is null. A component whose eigenvalue is zero has a null for every row, and no part in
    the identity error. Of equal eigenvalues any order may come. An empty table, or one
    without a usable vector, gives no rows, n = 0 and an error of zero.
    """
    distinct = cut_lineage(distinct_vectors(rows))
    fit = fit_whitening(distinct, components)
    error = identity_error(distinct, fit)
    kind = rows.schema["vec_id"].dataType
    shape = T.StructType([T.StructField("vec_id", kind), T.StructField("deviation", T.DecimalType(38, 0)),
                          T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    dims = len(fit.sums)

    def project(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, matrix in vectors_of(batch.column(1)):
                if not len(at):
                    continue
                whole = np.zeros((len(at), dims), np.int64)
                whole[:, :matrix.shape[1]] = steps(matrix)
                centred = fit.centred(whole)
                white = fit.whitened(centred)
                lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * white.shape[1], pa.array(white.ravel(), mask=np.isnan(white).ravel()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), squares(centred), lists], ["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "embedding").mapInArrow(project, shape), fit, error


def squares(centred: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exact; null where it has more than 38 digits."""
    most = int(np.abs(centred).max(initial=0))
    if centred.dtype != object and centred.shape[1] * most * most < 1 << 62:
        return pa.array((centred * centred).sum(axis=1)).cast(pa.decimal128(38, 0))
    sums = [sum(int(v) ** 2 for v in row) for row in centred]
    return pa.array([Decimal(s) if s < 10 ** 38 else None for s in sums], pa.decimal128(38, 0))


def components_of(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component of ``whiten``.

    A deviation beyond a long is null here.
    """
    vectors, fit, error = whiten(rows, components)
    shares = F.array(*[F.lit(v) for v in fit.explained]) if fit.explained else F.array().cast("array<double>")
    long = vectors.select("vec_id", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
