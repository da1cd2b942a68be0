"""Embedding jobs: sums, prototypes, exact neighbours, clusters, zero-shot tags, heads."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ranking import grouped_positions

BLOCK = 512      # rows of one side of a block product: bounds the memory of a task
SPREAD = 16      # blocks that all rows of a table are dealt to, whatever its size
LEAST_BLOCK, WIDEST = 256, 65_536  # rows below which a block is not made and above which there are more blocks
PRODUCT = 4_194_304  # entries of a block product that a task holds at once
CLASS_LIMIT = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def group_sums(df: DataFrame, by: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """Vector sum, row count and sum of squared norms per group, combined on the map side."""
    scaled = F.col(vector) if weight is None else F.transform(vector, lambda x: x.cast("double") * weight)
    df = df.withColumn("_v", array_to_vector(F.transform(scaled, lambda x: x.cast("double")))).withColumn("_sq", dot(F.col(vector), F.col(vector)))
    return df.groupBy(*by).agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("total"), F.count("*").alias("m"), F.sum("_sq").alias("squares"))


def consistency(df: DataFrame, group: str, vector: str, foils: int, seed: int = 7) -> DataFrame:
    """Mean pairwise cosine inside a group, and its margin over drawn other groups, from sums alone."""
    sums = group_sums(df, [group], vector)
    ranked = grouped_positions(sums, [], [F.col(group)], "at", "groups")
    mean = F.transform("total", lambda x: x / F.col("m"))
    inside = (dot(F.col("total"), F.col("total")) - F.col("squares")) / (F.col("m") * (F.col("m") - 1))
    base = cut_lineage(ranked.select(group, "m", "at", "groups", mean.alias("mean"), F.when(F.col("m") >= 2, inside).alias("inside")))
    jump = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.col("groups") - 1)
    asked = (base.where("m >= 2 and groups >= 2").withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.lit(foils), F.col("groups").cast("int") - 1) - 1)))
             .withColumn("other", F.pmod(F.col("at") + jump, F.col("groups")) + 1))
    other = base.select(F.col("at").alias("other"), F.col("mean").alias("other_mean"))
    drawn = asked.join(other, "other").groupBy(group).agg(F.avg(dot(F.col("mean"), F.col("other_mean"))).alias("foil"))
    return base.where("m >= 2").join(drawn, group, "left").select(group, "m", "inside", (F.col("inside") - F.col("foil")).alias("separation"))


def prototypes(seeds: DataFrame, group: str, vector: str, weight: str, sigma: float = 2.0) -> DataFrame:
    """Weighted mean direction per group, recomputed without members two sd below the mean similarity."""
    first = group_sums(seeds, [group], vector, F.col(weight)).select(group, unit(F.col("total")).alias("_p"))
    scored = seeds.join(first, group).withColumn("_s", dot(F.col(vector), F.col("_p")))
    floor = scored.groupBy(group).agg((F.avg("_s") - sigma * F.stddev_pop("_s")).alias("_floor"), F.count("*").alias("_n"))
    kept = scored.join(floor, group).where((F.col("_n") < 3) | (F.col("_s") >= F.col("_floor")))
    final = group_sums(kept, [group], vector, F.col(weight))
    sizes = floor.select(group, F.col("_n").alias("n_seeds"))
    return final.join(sizes, group).select(group, "n_seeds", F.col("m").alias("n_kept"), unit(F.col("total")).alias("prototype"))


def frame_contrast(df: DataFrame, frame: list[str], score: str) -> DataFrame:
    """Min-max contrast of a score inside a frame; a frame without contrast gives 1."""
    ends = df.groupBy(*frame).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    return df.join(ends, frame).withColumn("contrast", F.when(spread > 1e-9, (F.col(score) - F.col("_lo")) / spread).otherwise(1.0)).drop("_lo", "_hi")


def _blocks(df: DataFrame, unit_cols: list[str], id_col: str) -> DataFrame:
    """Give every row a block number inside its unit, blocks of about BLOCK rows."""
    sizes = df.groupBy(*unit_cols).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("_k"))
    return df.join(sizes, unit_cols).withColumn("_i", F.pmod(F.xxhash64(F.col(id_col)), F.col("_k")).cast("int"))


def close_pairs(df: DataFrame, unit_cols: list[str], id_col: str, vector: str, threshold: float) -> DataFrame:
    """Pairs (a < b) of one unit with cosine >= threshold.

    A unit is cut into blocks and a task multiplies two blocks, so a huge unit
    becomes many bounded tasks and only qualifying pairs leave them.
    """
    blocked = _blocks(df.select(*unit_cols, F.col(id_col).alias("_id"), F.col(vector).alias("_v")), unit_cols, "_id")
    # Block i meets every block j >= i once: a row goes to (i, j) and to (j, i).
    copies = blocked.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    task = copies.select(*unit_cols, F.least("_i", "_j").alias("_lo"), F.greatest("_i", "_j").alias("_hi"), (F.col("_i") <= F.col("_j")).alias("_left"), (F.col("_i") == F.col("_j")).alias("_same"), "_id", "_v")
    id_type = df.schema[id_col].dataType
    fields = [df.schema[c] for c in unit_cols] + [T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("cosine", T.DoubleType())]

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["_left"]]
        right = pdf if pdf["_same"].iloc[0] else pdf[~pdf["_left"]]
        if left.empty or right.empty:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in fields})
        x, y = np.stack(left["_v"].to_numpy()).astype(float), np.stack(right["_v"].to_numpy()).astype(float)
        sim = x @ y.T
        rows, cols = np.nonzero(sim >= threshold)
        a, b = left["_id"].to_numpy()[rows], right["_id"].to_numpy()[cols]
        ordered = a < b if pdf["_same"].iloc[0] else np.ones(len(a), bool)
        a, b, s = a[ordered], b[ordered], sim[rows, cols][ordered]
        out = {c: [pdf[c].iloc[0]] * len(a) for c in unit_cols}
        return pd.DataFrame({**out, "a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": s})

    return task.groupBy(*unit_cols, "_lo", "_hi").applyInPandas(product, T.StructType(fields))


def _best(sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest entry of every row to 12 digits and the first place of those equal to it."""
    at = sim.argmax(axis=1)
    top = sim[np.arange(len(sim)), at]
    close = np.nonzero(np.count_nonzero(sim >= (top - 2e-12)[:, None], axis=1) > 1)[0]
    if len(close):
        at[close] = np.round(sim[close], 12).argmax(axis=1)
    return np.round(top, 12), at


def nearest_cosine(df: DataFrame, id_col: str, vector: str, group: str, code: str | None = None, code_floor: int = 8) -> DataFrame:
    """Exact nearest other row by cosine (to 12 digits; ties: smaller id), as ``neighbour`` and ``cosine``.

    Rows are dealt to SPREAD blocks, more only when a block would pass WIDEST
    rows, and a task multiplies two blocks for both sides. A row is thus sent
    SPREAD + 1 times however many rows there are, and a task holds two blocks
    and a bounded piece of their product. With ``code`` (two 32-bit halves)
    ``far_neighbour`` and ``far_cosine`` come from the same products: the
    nearest row but for same-group ones with fewer than ``code_floor`` differing bits.
    """
    codes = [code] if code else []
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"), F.col(group).alias("_g"), *[F.col(c).alias("_h") for c in codes])
    n = df.count()
    blocks = max(1, min(SPREAD, -(-n // LEAST_BLOCK)), -(-n // WIDEST))
    dealt = rows.withColumn("_i", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    copies = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    task = copies.select(F.least("_i", "_j").alias("_lo"), F.greatest("_i", "_j").alias("_hi"), (F.col("_i") <= F.col("_j")).alias("_left"), *rows.columns)
    id_type = df.schema[id_col].dataType
    found = [T.StructField("neighbour", id_type), T.StructField("cosine", T.DoubleType())]
    if codes:
        found += [T.StructField("far_neighbour", id_type), T.StructField("far_cosine", T.DoubleType())]
    out_type = T.StructType([T.StructField("_id", id_type), *found])

    def side(pdf: pd.DataFrame) -> tuple:
        pdf = pdf.sort_values("_id")
        return (pdf["_id"].to_numpy(), pdf["_g"].to_numpy(), np.stack(pdf["_v"].to_numpy()).astype(float),
                pdf["_h"].to_numpy().astype(np.int64).view(np.uint64) if codes else None)

    def answers(sim: np.ndarray, a: tuple, b: tuple) -> list[np.ndarray]:
        """[cosine, place in b] of every row of a, with codes also those of the far neighbour."""
        top, at = _best(sim)
        if not codes:
            return [top, at]
        far_top, far_at = top.copy(), at.copy()
        hidden = np.nonzero((a[1] == b[1][at]) & (np.bitwise_count(a[3] ^ b[3][at]) < code_floor))[0]
        if len(hidden):
            left = sim[hidden]
            left[(a[1][hidden][:, None] == b[1][None, :]) & (np.bitwise_count(a[3][hidden][:, None] ^ b[3][None, :]) < code_floor)] = -2.0
            far_top[hidden], far_at[hidden] = _best(left)
        return [top, at, far_top, far_at]

    def told(a: tuple, b: tuple, best: list[np.ndarray]) -> pd.DataFrame:
        out = {"_id": pd.Series(a[0])}
        for name, top, at in zip(("", "far_"), best[::2], best[1::2]):
            out[f"{name}neighbour"] = pd.Series(b[0][at].astype(object)).where(pd.Series(top > -2.0), None)
            out[f"{name}cosine"] = np.where(top > -2.0, top, np.nan)
        return pd.DataFrame(out)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["_lo"].iloc[0] == pdf["_hi"].iloc[0]
        left = pdf[pdf["_left"]]
        right = left if same else pdf[~pdf["_left"]]
        if left.empty or right.empty:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in out_type})
        a, b = side(left), side(right)
        step, pieces, back = max(1, PRODUCT // len(right)), [], None
        for start in range(0, len(left), step):
            part = tuple(None if x is None else x[start:start + step] for x in a)
            sim = part[2] @ b[2].T
            if same:
                sim[part[0][:, None] == b[0][None, :]] = -2.0
            pieces.append(answers(sim, part, b))
            if not same:
                other = answers(np.ascontiguousarray(sim.T), b, part)
                if back is None:
                    back = other
                for k in range(0, len(other), 2):
                    better = other[k] > back[k]  # pieces come in the order of ids, so the first of equals stays
                    back[k] = np.where(better, other[k], back[k])
                    back[k + 1] = np.where(better, other[k + 1] + start, back[k + 1])
        out = [told(a, b, [np.concatenate(x) for x in zip(*pieces)])]
        return pd.concat(out if same else [*out, told(b, a, back)])

    hits = task.groupBy("_lo", "_hi").applyInPandas(product, out_type)
    names = ["", "far_"] if codes else [""]
    best = hits.groupBy("_id").agg(*[F.min(F.when(F.col(f"{x}neighbour").isNotNull(), F.struct((-F.col(f"{x}cosine")).alias("c"), f"{x}neighbour"))).alias(f"_{x}best") for x in names])
    named = [c for x in names for c in (F.col(f"_{x}best.{x}neighbour").alias(f"{x}neighbour"), (-F.col(f"_{x}best.c")).alias(f"{x}cosine"))]
    return rows.select("_id", "_g").join(best, "_id", "left").select(F.col("_id").alias(id_col), F.col("_g").alias(group), *named)


def zero_shot(df: DataFrame, vector: str, bank: DataFrame, scale: float) -> DataFrame:
    """Class of every vector against a prompt bank (label, vector): max per class, scaled softmax, argmax.

    A map over the rows: one matrix product per Arrow batch.
    """
    rows = bank.orderBy("label").limit(CLASS_LIMIT + 1).collect()
    if len(rows) > CLASS_LIMIT:
        raise ValueError("the prompt bank must stay small")
    labels = sorted({r["label"] for r in rows})
    matrix = np.array([r["vector"] for r in rows], dtype=float)
    owner = np.array([labels.index(r["label"]) for r in rows])

    @F.pandas_udf("struct<label:string, confidence:double>")
    def tag(v: pd.Series) -> pd.DataFrame:
        raw = np.stack(v.to_numpy()).astype(float) @ matrix.T
        per = np.stack([raw[:, owner == i].max(axis=1) for i in range(len(labels))], axis=1) * scale
        soft = np.exp(per - per.max(axis=1, keepdims=True))
        soft /= soft.sum(axis=1, keepdims=True)
        best = soft.argmax(axis=1)
        return pd.DataFrame({"label": [str(labels[i]) for i in best], "confidence": soft[np.arange(len(best)), best]})

    return df.withColumn("_t", tag(F.col(vector))).withColumns({"tag": F.col("_t.label"), "tag_confidence": F.col("_t.confidence")}).drop("_t")


def gram_cells(df: DataFrame, keys: list[str], vector: str, scalars: list[str]) -> dict[tuple, np.ndarray]:
    """Moment matrices over [1, vector, scalars] per key, summed in tasks and in sixteen middle groups.

    Only (columns x columns) matrices travel; the keys must be few.
    """
    size_row = df.select(F.size(vector).alias("d")).first()
    width = 1 + size_row["d"] + len(scalars)
    key_fields = [df.schema[k] for k in keys]
    out_type = T.StructType(key_fields + [T.StructField("_slot", T.IntegerType()), T.StructField("_m", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        import pyspark
        slot = (pyspark.TaskContext.get().partitionId() if pyspark.TaskContext.get() else 0) % 16
        sums: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                x = np.column_stack([np.ones(len(part)), np.stack(part[vector].to_numpy()).astype(float), part[scalars].to_numpy(dtype=float)])
                sums[key] = sums.get(key, 0) + x.T @ x
        for key, m in sums.items():
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "_slot": [slot], "_m": [m.ravel()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[[0]].copy()
        first["_m"] = [np.sum(np.stack(pdf["_m"].to_numpy()), axis=0)]
        return first

    middle = df.select(*keys, vector, *scalars).mapInPandas(partial, out_type).groupBy(*keys, "_slot").applyInPandas(add, out_type)
    out: dict = {}
    for row in middle.toLocalIterator():
        key = tuple(row[k] for k in keys)
        out[key] = out.get(key, 0) + np.array(row["_m"]).reshape(width, width)
    return out


def nested_probe(cells: dict, d: int, targets: int, alphas=(1.0, 10.0, 100.0, 1000.0), dims=(4, 8, 16, 32)) -> np.ndarray:
    """Outer-fold R2 of ridge on principal components, alpha and width chosen on inner folds.

    ``cells``: fold -> moments over [1, X (d), y_0..y_(targets-1)]. Every fit of
    every fold and target is matrix algebra on sums of the same cells.
    """
    folds = sorted(cells)
    out_sse = np.zeros(targets)
    whole = sum(cells.values())

    def solve(train, k, alpha):
        n = train[0, 0]
        mean = train[0, 1:d + 1] / n
        cov = train[1:d + 1, 1:d + 1] - n * np.outer(mean, mean)
        values, vectors = np.linalg.eigh(cov)
        basis = vectors[:, ::-1][:, :k]
        var = values[::-1][:k]
        y_mean = train[0, d + 1:] / n
        cross = basis.T @ (train[1:d + 1, d + 1:] - n * np.outer(mean, y_mean))
        slope = basis @ (cross / (var[:, None] + alpha))
        return np.vstack([y_mean - mean @ slope, slope])  # (d+1, targets)

    def sse(test, b):
        xx, xy, yy = test[:d + 1, :d + 1], test[:d + 1, d + 1:], np.diag(test)[d + 1:]
        return yy - 2 * np.einsum("ij,ij->j", b, xy) + np.einsum("ij,ik,kj->j", b, xx, b)

    grid = [(k, a) for k in dims if k <= d for a in alphas]
    for f in folds:
        inner = [g for g in folds if g != f]
        train = sum(cells[g] for g in inner)
        scores = np.zeros((len(grid), targets))
        for g in inner:
            rest = train - cells[g]
            for i, (k, a) in enumerate(grid):
                scores[i] += sse(cells[g], solve(rest, k, a))
        best = scores.argmin(axis=0)
        for i, (k, a) in enumerate(grid):
            pick = best == i
            if pick.any():
                out_sse[pick] += sse(cells[f], solve(train, k, a))[pick]
    n, sy, syy = whole[0, 0], whole[0, d + 1:], np.diag(whole)[d + 1:]
    return 1 - out_sse / (syy - sy ** 2 / n)


def apply_heads(df: DataFrame, vector: str, coef: np.ndarray, intercept: np.ndarray, labels: list[str], top: int, floor: float) -> DataFrame:
    """Sigmoid heads on every row: best ``top`` labels with probability >= ``floor`` and the maximum."""
    @F.pandas_udf("struct<labels:array<string>, best:double>")
    def run(v: pd.Series) -> pd.DataFrame:
        z = np.clip(np.stack(v.to_numpy()).astype(float) @ coef.T + intercept, -30, 30)
        p = 1 / (1 + np.exp(-z))
        order = np.argsort(-p, axis=1, kind="stable")[:, :top]
        return pd.DataFrame({"labels": [[labels[j] for j in o if p[i, j] >= floor] for i, o in enumerate(order)], "best": p.max(axis=1)})

    return df.withColumn("_h", run(F.col(vector))).withColumns({"labels": F.col("_h.labels"), "best": F.col("_h.best")}).drop("_h")
