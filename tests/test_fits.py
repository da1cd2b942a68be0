"""Ridge fits of many rows against the same normal equations in sixty digits."""
import random
from decimal import Decimal as D
from decimal import localcontext

from haulstat.plans import pricing
from haulstat.plans.registry import QUERIES

DENSE = ["log1p_age", "log_km", "euro6", "np_value", "np_missing"]


def cells(rng):
    """A thousand million rows in 25 makes and three markets; only the market TR has new prices."""
    out = []
    for k in range(25):
        for market in ("TR", "EU", "US"):
            n, tr = rng.randrange(9_000_000, 16_000_000), market == "TR"
            mean = {"log1p_age": -0.4 + rng.gauss(0, 0.002), "log_km": 0.9 + rng.gauss(0, 0.002), "euro6": 0.6 + rng.gauss(0, 0.002),
                    "np_value": 0.05 + rng.gauss(0, 0.01) if tr else 0.0, "np_missing": 0.0 if tr else 1.0, "y": 0.55 + rng.gauss(0, 0.002)}
            var = {"log1p_age": 0.3, "log_km": 0.7, "euro6": 0.2, "np_value": 0.01 if tr else 0.0, "np_missing": 0.0, "y": 0.3}
            names = [*DENSE, "y"]
            row = {"market": market, "brand": f"M{k:02d}", "n": n, **{f"s_{a}": n * mean[a] for a in names}}
            for i, a in enumerate(names):
                for b in names[i:]:
                    lean = 0.06 if (a, b) == ("log_km", "y") else 0.0
                    row[f"s_{a}_{b}" if a != "y" else "s_yy"] = n * (mean[a] * mean[b] + (var[a] if a == b else lean))
            if not tr:  # a flag that is one everywhere sums what it multiplies
                row |= {f"s_{a}_np_missing": row[f"s_{a}"] for a in DENSE[:4]} | {"s_np_missing_np_missing": float(n), "s_np_missing": float(n), "s_np_missing_y": row["s_y"]}
            out.append(row)
    return out


def exact(rows):
    """{column: (coef, scale)} of the full design, penalty one, the new price at its mean where it is missing."""
    with localcontext() as context:
        context.prec = 60
        brands = sorted({r["brand"] for r in rows})
        columns = [*DENSE, "market_TR", "market_EU", *[f"brand_used_{b}" for b in brands]]
        known = sum(D(r["n"]) - D(r["s_np_missing"]) for r in rows)
        fill = sum(D(r["s_np_value"]) for r in rows) / known
        total, size = {}, len(columns) + 2

        def add(i, j, v):
            total[i, j] = total.get((i, j), D(0)) + v
            if i != j:
                total[j, i] = total[i, j]

        for r in rows:
            names = [*DENSE, "y"]
            one = {a: D(r[f"s_{a}"]) for a in names}
            two = {(a, b): D(r["s_yy" if a == "y" else f"s_{a}_{b}"]) for i, a in enumerate(names) for b in names[i:]}
            get = lambda a, b: two[(a, b) if (a, b) in two else (b, a)]
            v, m = "np_value", "np_missing"
            filled = {(a, b): get(a, b) + fill * ((a == v) * get(m, b) + (b == v) * get(a, m)) + (a == b == v) * fill * fill * get(m, m) for a, b in two}
            one[v] += fill * one[m]
            flags = [1 + columns.index(c) for c in (f"market_{r['market']}", f"brand_used_{r['brand']}") if c in columns]
            at = {a: size - 1 if a == "y" else 1 + columns.index(a) for a in names}
            add(0, 0, D(r["n"]))
            for i, f in enumerate(flags):
                for g in [0, *flags[i:]]:
                    add(f, g, D(r["n"]))
            for a in names:
                for g in [0, *flags]:
                    add(at[a], g, one[a])
            for (a, b), value in filled.items():
                add(at[a], at[b], value)
        n, p = total[0, 0], len(columns)
        cov = [[total.get((i, j), D(0)) - total[i, 0] * total[j, 0] / n for j in range(1, size)] for i in range(1, size)]
        sd = [(cov[i][i] / n).sqrt() for i in range(p)]
        system = [[cov[i][j] / sd[i] / sd[j] + (i == j) for j in range(p)] + [cov[i][p] / sd[i]] for i in range(p)]
        for k in range(p):
            for i in range(p):
                if i != k:
                    f = system[i][k] / system[k][k]
                    system[i] = [x - f * y for x, y in zip(system[i], system[k])]
        return {c: (float(system[i][p] / system[i][i]), float(sd[i])) for i, c in enumerate(columns)}


def test_full_design_keeps_its_digits_over_many_rows(spark, sf_dir, monkeypatch):
    rows = cells(random.Random(3))
    wanted = exact(rows)
    monkeypatch.setattr(pricing, "full_cells", lambda df, keys: [dict(r) for r in rows])
    got = {r["feature"]: (r["coef"], r["scale"]) for r in QUERIES["i01_ridge_full_design"](spark, sf_dir).collect()}
    assert got.pop("brand_used_other") == (0.0, 1.0)
    assert {c: v for c, v in got.items()} == {c: tuple(round(x, 6) for x in v) for c, v in wanted.items()}
