"""Heads fitted in shared scans against one direct Newton fit each."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haulstat.operators import heads as D


def direct(x, y, penalty=1.0):
    """Weights in standardised units by plain Newton steps."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge = penalty * np.diag([0.0] + [1.0] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 3 / np.abs(step).max())
    return w, mean, scale


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(600, 3)) * [1, 5, 0.1] + [0, 100, 2], columns=["a", "b", "c"])
    pdf["flat"] = 7.0
    pdf["fold"] = rng.integers(0, 5, 600)
    pdf["easy"] = (pdf.a + rng.normal(size=600) > 0.4).astype(int)
    pdf["rare"] = ((pdf.b > 108) & (pdf.fold != 0) | (pdf.index == 3)).astype(int)
    pdf["never"] = 0
    pdf["only_fold_2"] = ((pdf.fold == 2) & (pdf.a > 0)).astype(int)
    return pdf


COLUMNS, LABELS = ["a", "b", "c", "flat"], ["easy", "rare", "never", "only_fold_2"]


@pytest.mark.parametrize("parts", [1, 9])
def test_heads_equal_direct_fits(spark, rows, parts):
    heads = D.fit_heads(spark.createDataFrame(rows).repartition(parts), COLUMNS, LABELS)
    assert heads.scans < 25
    x = rows[COLUMNS].to_numpy()
    for f in [D.ALL, 0, 1, 2, 3, 4]:
        mine = (rows.fold != f).to_numpy()
        for label in LABELS:
            y = rows[label].to_numpy()[mine]
            if 0 < y.sum() < len(y):
                assert np.allclose(heads.weights[f, label], direct(x[mine], y)[0], atol=1e-5), (f, label)
            else:
                assert (f, label) not in heads.weights
    assert (2, "only_fold_2") not in heads.weights and (D.ALL, "never") not in heads.weights
    packed = heads.packed()
    assert {(h, c) for h, c, *_ in packed} == {(h, c) for h in ("easy", "rare", "only_fold_2") for c in COLUMNS}


def test_scores_are_held_out_and_ranked(spark, rows):
    frame = spark.createDataFrame(rows.assign(row=rows.index))
    heads = D.fit_heads(frame, COLUMNS, LABELS)
    scored = D.held_out_scores(frame, heads, ["row", *LABELS])
    got = {r.row: r.scores for r in scored.collect()}
    x = rows[COLUMNS].to_numpy()
    for k in (0, 77, 599):
        f = rows.fold[k]
        w, mean, scale = direct(x[rows.fold != f], rows.easy[rows.fold != f].to_numpy())
        assert abs(got[k][0] - 1 / (1 + np.exp(-(w[0] + ((x[k] - mean) / scale) @ w[1:])))) < 1e-5 and got[k][2] == 0
    aucs = {r["head"]: r for r in D.head_aucs(scored, LABELS, {c: c for c in LABELS}).collect()}
    assert set(aucs) == {"easy", "rare", "only_fold_2"}
    s, y = np.array([got[k][0] for k in range(600)]), rows.easy.to_numpy()
    above = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    assert abs(aucs["easy"].auc - above) < 1e-9 and aucs["easy"].positives == y.sum()


def test_nothing_to_fit(spark, rows):
    empty = spark.createDataFrame(rows).limit(0)
    heads = D.fit_heads(empty, COLUMNS, LABELS)
    assert heads.weights == {} and heads.packed() == []
    assert D.held_out_scores(empty.withColumn("row", F.lit(1)), heads, ["row"]).collect() == []


def test_softmax_heads_are_at_the_optimum(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4)) * [1, 3, 0.2, 1] + [0, 5, 1, 0]
    y = np.array(["p", "q", "r"])[np.argmax(x @ rng.normal(size=(4, 3)) + rng.gumbel(size=(500, 3)), axis=1)]
    fold = rng.integers(0, 3, 500)
    frame = spark.createDataFrame([(k, x[k].tolist(), str(y[k]), int(fold[k])) for k in range(500)], "k int, x array<double>, y string, fold int").repartition(5)
    heads = D.fit_softmax(frame, "x", "y", tolerance=1e-8)
    assert heads.classes == ["p", "q", "r"] and heads.scans < 60
    for f in (D.ALL, 0, 1, 2):
        mine = fold != f
        z = np.column_stack([np.ones(mine.sum()), (x[mine] - x[mine].mean(0)) / x[mine].std(0)])
        w = heads.weights[f]
        p = np.exp(z @ w)
        p /= p.sum(axis=1, keepdims=True)
        gradient = z.T @ ((y[mine][:, None] == heads.classes) - p) - np.vstack([np.zeros(3), w[1:]])
        assert np.abs(gradient).max() < 1e-4
    got = {r.k: r.predicted for r in D.held_out_classes(frame, heads, "x", ["k"]).collect()}
    want = {k: heads.classes[int(np.argmax(np.append(1, (x[k] - x[fold != fold[k]].mean(0)) / x[fold != fold[k]].std(0)) @ heads.weights[int(fold[k])]))] for k in range(500)}
    assert got == want and np.mean([got[k] == y[k] for k in got]) > 0.5
    assert D.fit_softmax(frame.limit(0), "x", "y").weights == {}
