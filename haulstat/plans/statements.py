"""Parts of DuckDB statements that several queries share: permutations and ridge fits."""
from __future__ import annotations


def permuted_sql(name: str, source: str, value: str, row: str, strata: str, draws: int, seed: str, block: int = 4096) -> str:
    """CTE ``name``: the rows of ``source`` for each draw with the value ``pv`` they take, draw 0 as they are."""
    part = f"PARTITION BY {strata}, _block" if strata else "PARTITION BY _block"
    whole = f"OVER (PARTITION BY {strata})" if strata else "OVER ()"
    keys = f"{strata}, _block" if strata else "_block"
    top = 2 * block + 60 * (draws + 10)
    return f"""
{name}_primes AS (SELECT row_number() OVER (ORDER BY k) AS draw, k AS p FROM range({2 * block + 1}, {top}, 2) t(k)
  WHERE NOT EXISTS (SELECT 1 FROM range(3, {int(top ** 0.5) + 2}, 2) u(q) WHERE k % q = 0 AND q * q <= k)),
{name}_draws AS (SELECT 0 AS draw, 1 AS p UNION ALL SELECT draw, p FROM {name}_primes WHERE draw <= {draws}),
{name}_sized AS (SELECT *, ('0x' || substr(md5('{seed}-block|' || {row}), 1, 8))::BIGINT % ceil(count(*) {whole} / {float(block)})::BIGINT AS _block FROM {source} WHERE {value} IS NOT NULL),
{name}_placed AS (SELECT *, row_number() OVER ({part} ORDER BY md5('{seed}|' || {row}), {row}) - 1 AS _i, count(*) OVER ({part}) AS _m,
  row_number() OVER (ORDER BY {keys}, {row}) - row_number() OVER ({part} ORDER BY {row}) AS _base, row_number() OVER (ORDER BY {keys}, {row}) - 1 AS _at FROM {name}_sized),
{name}_values AS (SELECT _at, {value} AS _value FROM {name}_placed),
{name} AS NOT MATERIALIZED (SELECT a.*, d.draw, CASE WHEN d.draw = 0 THEN a.{value} ELSE b._value END AS pv FROM {name}_placed a CROSS JOIN {name}_draws d
  JOIN {name}_values b ON b._at = a._base + (d.p * a._i + d.draw) % a._m)"""


def ridge_sql(name: str, moments: str, columns: int, held_out: bool = True, alpha: float = 1.0) -> str:
    """CTEs ``name``_coef (tag, fold, i, coef, sd, mean, n) and ``name``_r2 (tag, n, r2, sse, sst) from ``moments`` (tag, fold, i, j, v).

    Index 0 is the constant, 1 to ``columns`` the columns, 999 the target; pairs that are absent are zero. The
    standardised normal equations of every (tag, fold) are solved together, one column a round. With
    ``held_out`` a fold is fitted on the others, else on itself.
    """
    others = "sum(v) OVER (PARTITION BY tag, i, j) - v" if held_out else "v"
    return f"""
{name}_idx AS (SELECT unnest(range(0, {columns + 1})) AS i UNION ALL SELECT 999),
{name}_dense AS (SELECT f.tag, f.fold, a.i, b.i AS j, coalesce(m.v, 0)::DOUBLE AS v FROM (SELECT DISTINCT tag, fold FROM {moments}) f CROSS JOIN {name}_idx a CROSS JOIN {name}_idx b
  LEFT JOIN {moments} m ON m.tag = f.tag AND m.fold = f.fold AND m.i = a.i AND m.j = b.i),
{name}_train AS (SELECT tag, fold, i, j, {others} AS v FROM {name}_dense),
{name}_head AS (SELECT tag, fold, i, v AS s, max(CASE WHEN i = 0 THEN v END) OVER (PARTITION BY tag, fold) AS n FROM {name}_train WHERE j = 0),
{name}_cov AS (SELECT t.tag, t.fold, t.i, t.j, t.v - a.s * b.s / a.n AS c, a.n, a.s FROM {name}_train t JOIN {name}_head a ON a.tag = t.tag AND a.fold = t.fold AND a.i = t.i
  JOIN {name}_head b ON b.tag = t.tag AND b.fold = t.fold AND b.i = t.j WHERE t.i BETWEEN 1 AND {columns} AND t.j > 0),
{name}_sd AS (SELECT tag, fold, i, CASE WHEN c / n <= 1e-12 THEN 1.0 ELSE sqrt(c / n) END AS d, s / n AS mean, n FROM {name}_cov WHERE i = j),
{name}_sys AS (SELECT c.tag, c.fold, c.i, list(CASE WHEN c.j = 999 THEN c.c / a.d ELSE c.c / a.d / b.d + (c.i = c.j)::INT * {alpha}::DOUBLE END ORDER BY c.j) AS r
  FROM {name}_cov c JOIN {name}_sd a ON a.tag = c.tag AND a.fold = c.fold AND a.i = c.i LEFT JOIN {name}_sd b ON b.tag = c.tag AND b.fold = c.fold AND b.i = c.j GROUP BY 1, 2, 3),
{name}_elim AS (SELECT tag, fold, i, 0 AS step, r FROM {name}_sys UNION ALL
  SELECT tag, fold, i, step + 1, CASE WHEN i = step + 1 THEN [r[x] / r[1] FOR x IN range(2, len(r) + 1)] ELSE [r[x] - r[1] * p[x] / p[1] FOR x IN range(2, len(r) + 1)] END
  FROM (SELECT *, max(CASE WHEN i = step + 1 THEN r END) OVER (PARTITION BY tag, fold) AS p FROM {name}_elim WHERE step < {columns})),
{name}_coef AS (SELECT s.tag, s.fold, s.i, e.r[1] AS coef, s.d AS sd, s.mean, s.n FROM {name}_elim e JOIN {name}_sd s ON s.tag = e.tag AND s.fold = e.fold AND s.i = e.i WHERE e.step = {columns}),
{name}_beta AS (SELECT tag, fold, i, -coef / sd AS b FROM {name}_coef UNION ALL SELECT DISTINCT tag, fold, 999, 1.0 FROM {name}_coef UNION ALL
  SELECT c.tag, c.fold, 0, sum(c.coef / c.sd * c.mean) - max(h.s / h.n) FROM {name}_coef c JOIN {name}_head h ON h.tag = c.tag AND h.fold = c.fold AND h.i = 999 GROUP BY 1, 2),
{name}_sse AS (SELECT d.tag, sum(a.b * b.b * d.v) AS sse FROM {name}_dense d JOIN {name}_beta a ON a.tag = d.tag AND a.fold = d.fold AND a.i = d.i
  JOIN {name}_beta b ON b.tag = d.tag AND b.fold = d.fold AND b.i = d.j GROUP BY 1),
{name}_all AS (SELECT tag, sum(CASE WHEN i = 0 AND j = 0 THEN v END) AS n, sum(CASE WHEN i = 0 AND j = 999 THEN v END) AS z, sum(CASE WHEN i = 999 AND j = 999 THEN v END) AS zz FROM {name}_dense GROUP BY 1),
{name}_r2 AS (SELECT a.tag, a.n, s.sse, a.zz - a.z * a.z / a.n AS sst, 1 - s.sse / (a.zz - a.z * a.z / a.n) AS r2 FROM {name}_all a JOIN {name}_sse s USING (tag))"""
