"""Linear heads by Newton's method: every label and every fold is fitted in the same scans.

A scan adds up, for each (fold left out, label), the gradient and the curvature at the current
weights; only these (columns x columns) sums reach the driver, where all steps are taken together. The number of
scans is that of the slowest head, not of heads times folds.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking as R

ALL = -1  # the fit that leaves no fold out


@dataclass
class Heads:
    """Weights over [1, columns] in standardised units, by (fold left out, label); means and scales by fold left out."""

    columns: list[str]
    labels: list[str]
    weights: dict[tuple[int, str], np.ndarray]
    mean: dict[int, np.ndarray]
    scale: dict[int, np.ndarray]
    scans: int

    def packed(self, digits: int = 5) -> list[tuple]:
        """(label, column, coefficient, intercept, mean, scale) of the fits on all rows."""
        out = []
        for label in self.labels:
            if (ALL, label) in self.weights:
                w = self.weights[ALL, label]
                out += [(label, c, round(float(w[i + 1]), digits), round(float(w[0]), digits), round(float(self.mean[ALL][i]), digits), round(float(self.scale[ALL][i]), digits))
                        for i, c in enumerate(self.columns)]
        return out


def standards(df: DataFrame, columns: list[str], labels: list[str], fold: str):
    """(means, scales, positives, rows) by fold left out, from one pass."""
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)], *[F.sum(F.col(c) * F.col(c)).alias(f"q{i}") for i, c in enumerate(columns)],
            *[F.sum(c).alias(f"p{j}") for j, c in enumerate(labels)]]
    per = {r[fold]: np.array([float(v or 0) for v in r[1:]]) for r in df.groupBy(fold).agg(*sums).collect()}
    whole, d = sum(per.values()), len(columns)
    mean, scale, positives, rows = {}, {}, {}, {}
    for f in [ALL, *sorted(per)]:
        t = whole - per[f] if f != ALL else whole
        if t[0] <= 0:
            continue
        mean[f] = t[1:d + 1] / t[0]
        spread = np.sqrt(np.maximum(t[d + 1:2 * d + 1] / t[0] - mean[f] ** 2, 0.0))
        scale[f] = np.where(spread <= 1e-12, 1.0, spread)
        positives[f], rows[f] = t[2 * d + 1:], t[0]
    return mean, scale, positives, rows


def newton_sums(df: DataFrame, columns: list[str], labels: list[str], fold: str, weights, mean, scale) -> dict:
    """(fold left out, label) -> (curvature, gradient of the log-likelihood, log-likelihood), from one scan."""
    by_fit: dict[int, list[int]] = {}
    for f, label in weights:
        by_fit.setdefault(f, []).append(labels.index(label))
    matrices = {f: np.column_stack([weights[f, labels[j]] for j in js]) for f, js in by_fit.items()}
    d = len(columns) + 1

    def partial(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            data = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            own, x, y = data[0], np.column_stack(data[1:d]), np.column_stack(data[d:])
            for f, js in by_fit.items():
                mine = own != f
                z = np.column_stack([np.ones(int(mine.sum())), (x[mine] - mean[f]) / scale[f]])
                score = z @ matrices[f]
                p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
                target = y[mine][:, js]
                likely = (target * score - np.logaddexp(0, score)).sum(axis=0)
                slope = z.T @ (target - p)
                for k, j in enumerate(js):
                    bend = z.T @ (z * (p[:, k] * (1 - p[:, k]))[:, None])
                    sums = np.concatenate([bend.ravel(), slope[:, k], [likely[k]]])
                    total[f, j] = total.get((f, j), 0) + sums
        for (f, j), sums in total.items():
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array([f] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(sums)], ["fit", "label", "at", "value"])

    sent = df.select(F.col(fold).cast("double"), *[F.col(c).cast("double") for c in [*columns, *labels]])
    parts = sent.mapInArrow(partial, "fit int, label int, at int, value double").groupBy("fit", "label", "at").agg(F.sum("value").alias("value"))
    out: dict = {}
    for r in parts.collect():
        out.setdefault((r.fit, labels[r.label]), np.zeros(d * d + d + 1))[r.at] = r.value
    return {k: (v[:d * d].reshape(d, d), v[d * d:-1], v[-1]) for k, v in out.items()}


def fit_heads(df: DataFrame, columns: list[str], labels: list[str], fold: str = "fold", penalty: float = 1.0, most: int = 40, tolerance: float = 1e-7) -> Heads:
    """A logistic head for each label, on all rows and on those outside each fold, with ``penalty`` on the squared standardised weights.

    ``df`` has the columns, 0/1 labels and a fold number of 0 or more, without nulls. A label of
    one value among a fit's rows has no head there. A step that lowers the penalised likelihood is
    halved. An empty table has no heads. ``df`` is scanned once per step: store it first.
    """
    mean, scale, positives, rows = standards(df, columns, labels, fold) if df.limit(1).count() else ({}, {}, {}, {})
    d = len(columns) + 1
    ridge = penalty * np.diag([0.0] + [1.0] * (d - 1))
    open_: dict = {}
    for f in mean:
        for j, label in enumerate(labels):
            if 0 < positives[f][j] < rows[f]:
                share = positives[f][j] / rows[f]
                open_[f, label] = np.concatenate([[np.log(share / (1 - share))], np.zeros(d - 1)])
    done: dict = {}
    held: dict = {}  # the last accepted weights and what they reach
    scans = 0
    while open_ and scans < most:
        scans += 1
        sums = newton_sums(df, columns, labels, fold, open_, mean, scale)
        following = {}
        for key, w in open_.items():
            bend, slope, likely = sums[key]
            reached = likely - 0.5 * penalty * float(w[1:] @ w[1:])
            if key in held and reached < held[key][1] - 1e-9 * abs(held[key][1]):
                following[key] = (w + held[key][0]) / 2
                continue
            held[key] = w, reached
            step = np.linalg.solve(bend + ridge + 1e-12 * np.eye(d), slope - ridge @ w)
            if np.abs(step).max() < tolerance:
                done[key] = w + step
            else:
                following[key] = w + step
        open_ = following
    return Heads(columns, labels, {**done, **open_}, mean, scale, scans)


def held_out_scores(df: DataFrame, heads: Heads, keep: list[str], fold: str = "fold") -> DataFrame:
    """``keep`` of every row with scores array<double>: each label's probability by the fit that left the row's fold out, 0 without one."""
    d = len(heads.columns)
    shape = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    matrices = {f: np.column_stack([heads.weights.get((f, label), np.full(d + 1, np.nan)) for label in heads.labels]) for f in heads.mean if f != ALL}

    def score(batches):
        for batch in batches:
            own = batch.column(len(keep)).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(len(keep) + 1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)])
            out = np.zeros((len(own), len(heads.labels)))
            for f, w in matrices.items():
                mine = own == f
                z = np.column_stack([np.ones(int(mine.sum())), (x[mine] - heads.mean[f]) / heads.scale[f]])
                out[mine] = np.nan_to_num(1 / (1 + np.exp(-np.clip(z @ w, -500, 500))))
            lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * len(heads.labels), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], lists], [*keep, "scores"])

    return df.select(*keep, fold, *heads.columns).mapInArrow(score, f"{shape}, scores array<double>")


def head_aucs(scored: DataFrame, labels: list[str], truth: dict[str, str]) -> DataFrame:
    """(head, auc, positives, negatives) of each label with both values, from average-tie ranks over all heads in one pass.

    ``truth`` maps a label to the 0/1 column of ``scored`` that tells it.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("head"), F.element_at("scores", i + 1).alias("p"), F.col(truth[c]).cast("int").alias("y")) for i, c in enumerate(labels)])
    long = scored.select(F.inline(pairs))
    ranked = R.rank_with_ties(long, ["head"], "p", "_r")
    n1, n0 = F.sum(F.col("y").cast("long")), F.sum((1 - F.col("y")).cast("long"))
    auc = (F.sum(F.when(F.col("y") == 1, F.col("_r"))) - n1 * (n1 + 1) / 2) / (n1 * n0)
    return ranked.groupBy("head").agg(F.when((n1 > 0) & (n0 > 0), auc).alias("auc"), n1.alias("positives"), n0.alias("negatives")).where("auc is not null")


@dataclass
class SoftHeads:
    """Softmax weights (1 + columns by classes) in standardised units, by fold left out."""

    classes: list
    weights: dict[int, np.ndarray]
    mean: dict[int, np.ndarray]
    scale: dict[int, np.ndarray]
    scans: int


def vectors_in(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def vector_moments(df: DataFrame, vector: str, width: int, fold: str) -> dict[int, np.ndarray]:
    """Moments of [1, vector] by fold, added up where the rows are."""
    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            own, x = batch.column(0).to_numpy(zero_copy_only=False), vectors_in(batch.column(1), width)
            z = np.column_stack([np.ones(len(x)), x])
            for f in np.unique(own).tolist():
                total[f] = total.get(f, 0) + z[own == f].T @ z[own == f]
        for f, m in total.items():
            n = m.size
            yield pa.RecordBatch.from_arrays([pa.array([f] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(m.ravel())], ["fit", "at", "value"])

    parts = df.select(F.col(fold).cast("int"), F.col(vector).cast("array<double>")).mapInArrow(partial, "fit int, at int, value double")
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("fit", "at").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r.fit, np.zeros((width + 1) ** 2))[r.at] = r.value
    return {f: m.reshape(width + 1, width + 1) for f, m in out.items()}


def softmax_sums(df: DataFrame, vector: str, width: int, label: str, classes: list, fold: str, weights, mean, scale) -> dict:
    """Fold left out -> (log-likelihood, its gradient), from one scan."""
    k = len(classes)
    place = {c: i for i, c in enumerate(classes)}

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            own, x = batch.column(0).to_numpy(zero_copy_only=False), vectors_in(batch.column(1), width)
            y = np.array([place[c] for c in batch.column(2).to_pylist()], int)
            for f, w in weights.items():
                mine = own != f
                z = np.column_stack([np.ones(int(mine.sum())), (x[mine] - mean[f]) / scale[f]])
                score = z @ w
                score -= score.max(axis=1, keepdims=True) if len(score) else 0
                spread = np.exp(score)
                norm = spread.sum(axis=1)
                at = np.arange(len(z)), y[mine]
                p = -spread / norm[:, None]
                p[at] += 1
                sums = np.concatenate([(z.T @ p).ravel(), [(score[at] - np.log(norm)).sum()]])
                total[f] = total.get(f, 0) + sums
        for f, sums in total.items():
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array([f] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(sums)], ["fit", "at", "value"])

    sent = df.select(F.col(fold).cast("int"), F.col(vector).cast("array<double>"), F.col(label))
    parts = sent.mapInArrow(partial, "fit int, at int, value double").groupBy("fit", "at").agg(F.sum("value").alias("value"))
    out: dict = {}
    for r in parts.collect():
        out.setdefault(r.fit, np.zeros((width + 1) * k + 1))[r.at] = r.value
    return {f: (float(v[-1]), v[:-1].reshape(width + 1, k)) for f, v in out.items()}


def fit_softmax(df: DataFrame, vector: str, label: str, fold: str = "fold", penalty: float = 1.0, most: int = 80, tolerance: float = 1e-6, memory: int = 10) -> SoftHeads:
    """Multinomial heads on all rows and outside each fold, all in the same scans.

    Quasi-Newton steps start from the curvature bound that the moments give, so a scan adds up
    gradients only; a step that does not lower the loss enough is halved. ``df`` has vectors
    of one length without nulls, a label without nulls and a fold of 0 or more. A fit ends when no mean
    gradient exceeds ``tolerance``, or after ``most`` scans. An empty table has no heads.
    """
    first = df.select(F.size(vector).alias("d")).first()
    if first is None:
        return SoftHeads([], {}, {}, {}, 0)
    d, classes = first["d"], sorted(r[0] for r in df.select(label).distinct().collect())
    per = vector_moments(df, vector, d, fold)
    whole, mean, scale, bound, rows = sum(per.values()), {}, {}, {}, {}
    for f in [ALL, *sorted(per)]:
        m = whole - per[f] if f != ALL else whole
        n = m[0, 0]
        if n < 0.5:
            continue
        mean[f] = m[0, 1:] / n
        spread = np.sqrt(np.maximum(np.diag(m)[1:] / n - mean[f] ** 2, 0.0))
        scale[f], rows[f] = np.where(spread <= 1e-12, 1.0, spread), n
        change = np.eye(d + 1)
        change[0, 1:] = -mean[f]
        change[:, 1:] /= scale[f]
        bound[f] = 0.5 * change.T @ m @ change + penalty * np.diag([1e-6] + [1.0] * d)
    open_ = {f: np.zeros((d + 1, len(classes))) for f in mean}
    ridge = np.array([0.0] + [penalty] * d)[:, None]
    held, done, scans = {}, {}, 0
    while open_ and scans < most:
        scans += 1
        sums = softmax_sums(df, vector, d, label, classes, fold, open_, mean, scale)
        following = {}
        for f, w in open_.items():
            likely, slope = sums[f]
            loss, gradient = -likely + 0.5 * float((ridge * w * w).sum()), ridge * w - slope
            pairs: list = []
            if f in held:
                old, old_loss, old_gradient, step, size, pairs = held[f]
                if loss > old_loss + 1e-4 * size * float((old_gradient * step).sum()):
                    held[f] = old, old_loss, old_gradient, step, size / 2, pairs
                    following[f] = old + size / 2 * step
                    continue
                s, y = w - old, gradient - old_gradient
                if float((s * y).sum()) > 1e-12:
                    pairs = [*pairs, (s, y)][-memory:]
            if np.abs(gradient).max() / rows[f] < tolerance:
                done[f] = w
                continue
            step = -two_loop(gradient, pairs, bound[f])
            held[f] = w, loss, gradient, step, 1.0, pairs
            following[f] = w + step
        open_ = following
    return SoftHeads(classes, {**done, **{f: held[f][0] for f in open_}}, mean, scale, scans)


def two_loop(gradient: np.ndarray, pairs: list, bound: np.ndarray) -> np.ndarray:
    """The inverse curvature that the (step, gradient change) pairs tell, from ``bound``, times the gradient."""
    q, kept = gradient.copy(), []
    for s, y in reversed(pairs):
        r = 1 / float((s * y).sum())
        a = r * float((s * q).sum())
        q = q - a * y
        kept.append((a, r))
    q = np.linalg.solve(bound, q)
    for (s, y), (a, r) in zip(pairs, reversed(kept)):
        q = q + s * (a - r * float((y * q).sum()))
    return q


def held_out_classes(df: DataFrame, heads: SoftHeads, vector: str, keep: list[str], fold: str = "fold") -> DataFrame:
    """``keep`` of every row and ``predicted``, the likeliest class by the fit that left the row's fold out (of equal ones the first)."""
    shape = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    d = len(next(iter(heads.mean.values()))) if heads.mean else 0

    def score(batches):
        for batch in batches:
            own, x = batch.column(len(keep)).to_numpy(zero_copy_only=False), vectors_in(batch.column(len(keep) + 1), d)
            out = [None] * len(own)
            for f in np.unique(own).tolist():
                if f in heads.weights:
                    at = np.flatnonzero(own == f)
                    best = (np.column_stack([np.ones(len(at)), (x[at] - heads.mean[f]) / heads.scale[f]]) @ heads.weights[f]).argmax(axis=1)
                    for i, b in zip(at.tolist(), best.tolist()):
                        out[i] = str(heads.classes[b])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(out, pa.string())], [*keep, "predicted"])

    return df.select(*keep, F.col(fold).cast("int"), F.col(vector).cast("array<double>")).mapInArrow(score, f"{shape}, predicted string")
