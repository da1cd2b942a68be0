"""Whitening against plain numpy on whole numbers."""
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulstat.llm import whitening
from haulstat.llm.queries import LLM_QUERIES


@pytest.mark.parametrize("low, high, shape", [(-70, 70, (1000, 7)), (-2 ** 61, 2 ** 61, (130, 5)), (5, 6, (70, 3)), (-3, 9, (1, 2)), (-10 ** 6, 10 ** 6, (5000, 4))])
def test_bit_planes_give_exact_products(low, high, shape):
    whole = np.random.default_rng(1).integers(low, high, shape)
    whole[0, 0] = high
    sums, cross = whitening.cross_products(whole)
    plain = whole.astype(object)
    assert (sums == plain.sum(axis=0)).all() and (cross == plain.T @ plain).all()
    assert (whitening.unpacked(whitening.packed(whole), shape[1]) == whole).all()


def brute(vectors, components=16):
    """Rows by index: (n, deviation, whitened up to a sign, explained)."""
    whole = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(whole, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    cov = centred.T @ centred / n
    values, turned = np.linalg.eigh(cov)
    values, turned = values[::-1][:components], turned[:, ::-1][:, :components]
    dev = [sum(int(v) ** 2 for v in n * row - sums) for row in whole]
    return n, dev, ((n * whole - sums) / n) @ turned / np.sqrt(values), values / np.trace(cov)


def test_query_against_numpy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = LLM_QUERIES["op11_whitening"](spark, sf_dir).toPandas()
    assert list(got.columns)[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, dev, white, explained = brute([r.embedding for r in rows])
    ids = [r.vec_id for r in rows]
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table * signs - white).max() < 1e-9 and table.shape == white.shape
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert dict(zip(got.vec_id, got.deviation)) == dict(zip(ids, dev))
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, explained, rtol=1e-9)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 1.0]), (2, None), (None, [0.1, 0.2]), (None, [0.1, 0.2]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [0.3, -2.0]), (7, [0.9, 7.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("name", "n", "component", "deviation", "i", "low")})
    out = whitening.components_of(frame).collect()
    n, dev, white, _ = brute([[0.5, 1.0], [0.1, 0.2], [0.1, 0.2], [0.3, -2.0], [0.9, 7.0]])
    assert n == 4 and Counter((r.vec_id, r.component) for r in out) == Counter({(1, 1): 1, (1, 2): 1, (None, 1): 2, (None, 2): 2, (7, 1): 2, (7, 2): 2})
    assert sorted(r.deviation for r in out) == sorted(dev * 2) and {r.n for r in out} == {4}
    assert np.allclose(sorted(abs(r.whitened) for r in out), sorted(np.abs(white).ravel()))


def test_lengths_sizes_and_flat_dimensions(spark):
    def run(rows):
        frame = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
        return whitening.components_of(frame).collect()

    ragged = run([(1, [1.0]), (2, [1.0, 0.0]), (3, []), (4, [2.0, 5.0])])  # short vectors have zeros at their end
    assert {r.n for r in ragged} == {4} and Counter(r.vec_id for r in ragged) == {k: 2 for k in (1, 2, 3, 4)}
    assert {r.component: r.whitened for r in ragged if r.vec_id == 1} == {r.component: r.whitened for r in ragged if r.vec_id == 2}
    flat = run([(1, [1.0, 3.0]), (2, [1.0, 4.0])])
    assert {r.component: r.whitened is None for r in flat if r.vec_id == 1} == {1: False, 2: True} and {r.deviation for r in flat} == {64 ** 2}
    alone = run([(1, [0.0, 0.0, 0.0])] * 3)
    assert len(alone) == 9 and all(r.whitened is None and r.deviation == 0 and r.n == 1 for r in alone)
    huge = run([(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id == 1} == {None}
    assert run([]) == [] and run([(1, None), (2, [nan_()])]) == []


def nan_():
    return float("nan")
