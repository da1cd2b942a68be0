"""Permutation nulls and whole-make hold-outs against direct computations."""
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haulstat.operators import holdouts as H
from haulstat.operators import permutations as M
from haulstat.plans import pricing, scorecards


def assigned(spark, rows, draws, block, parts=1):
    """draw -> {row: the value it takes}, read off indicator columns."""
    names = [r[1] for r in rows]
    frame = spark.createDataFrame(rows, "s string, id string, v double").repartition(parts)
    frame = frame.withColumns({f"is_{n}": (F.col("id") == n).cast("int") for n in names})
    got = M.permuted_sums(frame, "v", [f"is_{n}" for n in names], "id", draws, "seed", strata=["s"], block=block).collect()
    out: dict = {}
    for r in got:
        if r.term.startswith("is_"):
            out.setdefault(r.draw, {})[r.term[3:]] = r.value
    return out, {(r.draw, r.term): r.value for r in got}


@pytest.mark.parametrize("block", [3, 4096])
def test_every_draw_permutes_inside_its_stratum(spark, block):
    rows = [("a", f"r{k}", float(k * k)) for k in range(23)] + [(None, f"n{k}", 1000.0 + k) for k in range(5)] + [("one", "o", 7.0), ("two", "t0", 1.5), ("two", "t1", 2.5)]
    draws, sums = assigned(spark, rows, 12, block)
    stratum = {r[1]: r[0] for r in rows}
    for d, taken in draws.items():
        for s in {r[0] for r in rows}:
            assert sorted(taken[n] for n in stratum if stratum[n] == s) == sorted(r[2] for r in rows if r[0] == s)
        assert abs(sums[d, "1"] - sum(r[2] for r in rows)) < 1e-9 and abs(sums[d, "1^2"] - sum(r[2] ** 2 for r in rows)) < 1e-6
    assert draws[0] == {r[1]: r[2] for r in rows} and len(draws) == 13
    assert len({tuple(sorted(t.items())) for t in draws.values()}) > 6
    again, _ = assigned(spark, rows, 12, block, 7)
    assert again == draws


def test_draws_are_uniform(spark):
    draws, _ = assigned(spark, [("a", f"r{k}", float(k)) for k in range(6)], 1500, 4096)
    share = pd.DataFrame([t for d, t in draws.items() if d]).apply(lambda c: c.value_counts(normalize=True)).fillna(0)
    assert share.to_numpy().min() > 0.1 and share.to_numpy().max() < 0.24  # 1/6 each


def test_groups_and_squares(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": [f"{k:03d}" for k in range(200)], "g": rng.integers(0, 3, 200), "x": rng.normal(size=200), "v": rng.normal(size=200)})
    pdf.loc[::9, "v"] = np.nan
    frame = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = {(r.g, r.draw, r.term): r.value for r in M.permuted_sums(frame, "v", ["x"], "id", 3, "s", by=["g"], squares=["x"]).collect()}
    for g, part in pdf.dropna().groupby("g"):
        for term, want in {"1": part.v.sum(), "x": (part.x * part.v).sum(), "1^2": (part.v ** 2).sum(), "x^2": (part.x * part.v ** 2).sum()}.items():
            assert abs(got[g, 0, term] - want) < 1e-9
    assert abs(sum(got[g, 2, "1"] for g in range(3)) - pdf.v.sum()) < 1e-9
    assert M.permuted_sums(frame.limit(0), "v", ["x"], "id", 3, "s").collect() == []


def design_of(pdf, np_column):
    makes = sorted(b for b, n in pdf.brand.value_counts().items() if n >= 5) + ["other"]
    used = pdf.brand.where(pdf.brand.isin(makes), "other")
    return np.column_stack([pdf[["log1p_age", "log_km", "euro6"]].to_numpy(), *[(used == m).to_numpy(float) for m in makes], np_column])


def direct_ridge(x, y):
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1
    z = (x - mean) / scale
    coef = np.linalg.solve(z.T @ z + np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda q: (q - mean) / scale @ coef + y.mean()


def direct_r2(x, y, fold):
    resid = np.zeros(len(y))
    for f in np.unique(fold):
        resid[fold == f] = y[fold == f] - direct_ridge(x[fold != f], y[fold != f])(x[fold == f])
    return 1 - (resid ** 2).sum() / ((y - y.mean()) ** 2).sum()


def listings(n, models, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"listing_id": [f"l{k:04d}" for k in range(n)], "brand": rng.choice(["A", "B", "C"], n), "model": rng.choice([f"m{k}" for k in range(models)], n),
                        "fold": rng.integers(0, 5, n), "log1p_age": rng.uniform(1, 3, n), "log_km": rng.normal(12, 1, n), "euro6": rng.integers(0, 2, n).astype(float)})
    price = {k: 12 + rng.normal() for k in set(zip(pdf.brand, pdf.model))}
    pdf["log_new_price"] = [price[k] for k in zip(pdf.brand, pdf.model)]
    pdf["y"] = 0.8 * pdf.log_new_price - 0.3 * pdf.log1p_age + rng.normal(0, 0.3, n)
    return pdf


def test_price_nulls_against_direct_fits(spark):
    pdf = listings(220, 2, 5)
    got = pricing.price_nulls(spark.createDataFrame(pdf), draws=30)
    y, fold = pdf.y.to_numpy(), pdf.fold.to_numpy()
    assert abs(got["observed"] - direct_r2(design_of(pdf, pdf.log_new_price), y, fold)) < 1e-9
    keys = (pdf.brand + "|" + pdf.model)
    names = sorted(keys.unique())
    truth = pdf.groupby(keys).log_new_price.first()
    want = [direct_r2(design_of(pdf, keys.map(dict(zip(names, p)))), y, fold) for p in itertools.permutations(truth[n] for n in names)]
    assert got["n_models"] == len(names) == 6 and np.allclose(sorted(got["exact"]), sorted(want))
    assert len(got["models"]) == len(got["rows"]) == 30
    for v in got["models"]:
        assert min(abs(v - w) for w in want) < 1e-9  # each draw is one of the assignments
    reach, p = M.exact_share(got["rows"], got["observed"])
    assert (reach, p) == (0, 1 / 31) and max(got["rows"]) < got["observed"] - 0.1


def test_many_models_skip_the_exact_list(spark):
    got = pricing.price_nulls(spark.createDataFrame(listings(300, 12, 8)), draws=5)
    assert got["exact"] is None and got["n_models"] > 8 and len(got["models"]) == 5


def test_held_out_rows_enter_no_fit(spark):
    pdf = listings(300, 3, 9)
    pdf.loc[pdf.index % 4 == 0, "log_new_price"] = np.nan
    plain = lambda p: spark.createDataFrame(p).withColumn("log_new_price", F.when(~F.isnan("log_new_price"), F.col("log_new_price")))
    changed = pdf.copy()
    mine = changed.brand == "B"
    changed.loc[mine, "y"] += 5 * np.random.default_rng(1).normal(size=mine.sum())
    changed.loc[mine, "log_km"] -= 3
    changed.loc[mine, "log_new_price"] = 99.0
    for one, other in zip(H.make_fits(plain(pdf))[1], H.make_fits(plain(changed))[1]):
        same = [np.allclose(one.hedonic.coef, other.hedonic.coef), np.allclose(one.hedonic.mean, other.hedonic.mean), np.isclose(one.spread, other.spread),
                np.allclose(one.curve.coef, other.curve.coef), np.isclose(one.curve_spread, other.curve_spread)]
        assert all(same) if one.make == "B" else not any(same)


def test_holdout_prices_against_direct_fits(spark):
    pdf = listings(300, 3, 9)
    pdf.loc[pdf.index % 4 == 0, "log_new_price"] = np.nan
    pdf["new_price_source"] = np.where(pdf.index % 3 == 0, "trade_press", "oem_official")
    pdf = pd.concat([pdf, pdf.iloc[:2].assign(brand="rare", listing_id=["x", "y"])], ignore_index=True)
    frame = spark.createDataFrame(pdf).withColumn("log_new_price", F.when(~F.isnan("log_new_price"), F.col("log_new_price")))
    priced = H.price_unknown_makes(frame).toPandas()
    report = H.holdout_report(H.price_unknown_makes(frame)).toPandas().set_index("held")
    assert set(priced.held) == {"A", "B", "C"}
    for make in "ABC":
        rest, held = pdf[pdf.brand != make], pdf[pdf.brand == make]
        makes = sorted(b for b, n in rest.brand.value_counts().items() if n >= 3) + ["other"]

        def design(p):
            used = p.brand.where(p.brand.isin(makes), "other")
            return np.column_stack([p[["log1p_age", "log_km", "euro6"]].to_numpy(), *[(used == m).to_numpy(float) for m in makes]])

        def residuals(x, y, fold):
            out = np.zeros(len(y))
            for f in np.unique(fold):
                out[fold == f] = y[fold == f] - direct_ridge(x[fold != f], y[fold != f])(x[fold == f])
            return out

        resid = residuals(design(rest), rest.y.to_numpy(), rest.fold.to_numpy())
        lo, hi = np.quantile(resid, [0.1, 0.9])
        mu = direct_ridge(design(rest), rest.y.to_numpy())(design(held))
        known = rest.dropna(subset=["log_new_price"])
        cx, cy = known[["log1p_age", "log_km"]].to_numpy(), (known.y - known.log_new_price).to_numpy()
        csd = residuals(cx, cy, known.fold.to_numpy()).std()
        there = held.log_new_price.notna().to_numpy()
        other = held.log_new_price.to_numpy() + direct_ridge(cx, cy)(held[["log1p_age", "log_km"]].to_numpy())
        w, v = 1 / (resid.std() * 1.85) ** 2, 1 / (csd * np.where(held.new_price_source == "oem_official", 1.0, 1.35)) ** 2
        both = np.where(there, (w * mu + v * np.nan_to_num(other)) / (w + v), mu)
        factor = np.where(there, np.maximum(1.0, np.sqrt(1 / (w + v)) / resid.std()), 1.85)
        mine = priced[priced.held == make]
        assert np.allclose([mine.lo.iloc[0], mine.hi.iloc[0]], [lo, hi]) and np.allclose(np.sort(mine.plain), np.sort(mu))
        assert np.allclose(np.sort(mine.anchored), np.sort(both)) and np.allclose(np.sort(mine.factor), np.sort(factor))
        y = held.y.to_numpy()
        row = report.loc[make]
        assert row.n_held_out == len(held) and np.isclose(row.coverage_with_anchor, ((y >= both + lo * factor) & (y <= both + hi * factor)).mean())
        assert np.isclose(row.median_anchored, np.median(np.abs(np.expm1(both - y))) * 100) and np.isclose(row.mean_anchor_weight, (v / (w + v))[there].mean())


def test_holdout_of_too_few_rows(spark):
    pdf = listings(6, 2, 1).assign(new_price_source="oem_official")
    assert H.price_unknown_makes(spark.createDataFrame(pdf)).collect() == []


def test_stratified_null_centres_on_zero(spark):
    rng = random.Random(2)
    rows = [(f"{k}", rng.choice(["TR", "EU"]), rng.choice("AB"), rng.random() * 1e5, 2000 + rng.randrange(20), rng.random(), rng.randrange(30)) for k in range(400)]
    frame = spark.createDataFrame(rows, "listing_id string, market string, make string, km double, year int, price double, n_images int")
    tables = type("T", (), {"listings": frame, "spark": spark})()
    row = scorecards.stratified_null(tables, draws=400).first()
    assert row.draws == 400 and abs(row.null_mean) < 0.01 and row.null_low < -0.05 < 0.05 < row.null_high and 0.001 < row.negative_tail_p < 0.999
    worn = frame.withColumn("price", F.col("km") * -1 + F.col("price") * 20_000)
    assert scorecards.stratified_null(type("T", (), {"listings": worn, "spark": spark})(), draws=100).first().negative_tail_p == round(1 / 101, 6)


def test_usage_probe_against_direct_fits(spark):
    from haulstat.plans import embeddings as E
    pdf = listings(240, 3, 12).drop(columns="log_new_price")
    rng = np.random.default_rng(3)
    pdf["usage"] = (rng.random(240) < 0.3).astype(float)
    pdf["y"] -= 0.6 * pdf.usage
    got = E.usage_probe(spark.createDataFrame(pdf), draws=25)
    used = pdf.brand.to_numpy()
    base = np.column_stack([pdf[["log1p_age", "log_km", "euro6"]].to_numpy(), *[(used == m).astype(float) for m in sorted(set(used))]])
    y, fold = pdf.y.to_numpy(), pdf.fold.to_numpy()

    def fitted(x, y, alpha):
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-6] = 1
        z = (x - mean) / scale
        coef = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
        return (lambda q: (q - mean) / scale @ coef + y.mean()), coef

    def oof(x, y, fold, alpha):
        out = np.zeros(len(y))
        for f in np.unique(fold):
            out[fold == f] = fitted(x[fold != f], y[fold != f], alpha)[0](x[fold == f])
        return out

    def choose(x, y, fold):
        return min(E.USAGE_ALPHAS, key=lambda a: ((y - oof(x, y, fold, a)) ** 2).sum())

    def nested(x):
        out = np.zeros(len(y))
        for f in np.unique(fold):
            tr = fold != f
            out[~tr] = fitted(x[tr], y[tr], choose(x[tr], y[tr], fold[tr]))[0](x[~tr])
        return 1 - ((y - out) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    def coverage(x):
        hits = []
        for f in np.unique(fold):
            tr = fold != f
            inner = np.zeros(tr.sum())
            xt, yt, ft = x[tr], y[tr], fold[tr]
            for g in np.unique(ft):
                a = ft != g
                inner[~a] = fitted(xt[a], yt[a], choose(xt[a], yt[a], ft[a]))[0](xt[~a])
            lo, hi = np.quantile(yt - inner, [0.1, 0.9])
            left = y[~tr] - fitted(xt, yt, choose(xt, yt, ft))[0](x[~tr])
            hits += ((left >= lo) & (left <= hi)).tolist()
        return np.mean(hits)

    full = np.column_stack([base, pdf.usage])
    assert np.isclose(got["without"], nested(base)) and np.isclose(got["with"], nested(full))
    assert np.isclose(got["coefficient"], fitted(full, y, choose(full, y, fold))[1][-1]) and got["coefficient"] < 0
    assert np.isclose(got["coverage_base"], coverage(base)) and np.isclose(got["coverage_usage"], coverage(full))
    assert len(got["null"]) == 25 and got["null"].max() < got["with"]
