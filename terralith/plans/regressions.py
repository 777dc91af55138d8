"""Registered queries of regression with inference, clusters and weighted draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import clusters, inference, regression, sampling
from terralith.operators.graph import cut
from terralith.plans import predictive
from terralith.plans.registry import Registry
from terralith.sources import fixtures as fx

queries = Registry()
query = queries.add

#: A response with an effect of the neighbours' first feature and a draw by the key as noise.
_NOISE = "(CAST(pid * 104659 % 1009 AS DOUBLE) / 1009 - 0.5)"
_Y = f"3 + 2 * x1 - 1.5 * x2 + 0.8 * coalesce(w_x1, 0) + {_NOISE}"


def response(spark, sf_dir):
    """pid, features, lagged features and y, and the four nearest neighbours of each."""
    t = predictive.training(spark, sf_dir)
    near = cut(inference.nearest_weights(t, "pid", 4, 2000.0))
    lag = regression.lagged(t, "pid", ["x1", "x2"], near)
    e, n = "(x - 424000) / 10000", "(y - 4618000) / 10000"
    return cut(lag.selectExpr("pid", "x1", "x2", "w_x1", "w_x2", f"{e} AS e", f"{n} AS n", f"{e} * {e} AS ee", f"{n} * {n} AS nn", f"{e} * {n} AS en", f"{_Y} AS response")), near


_RESPONSE = f"""{predictive._TABLE}, q AS (SELECT a.pid AS i, b.pid AS j, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.pid) AS k FROM t a JOIN t b ON a.pid <> b.pid),
near AS MATERIALIZED (SELECT i, j FROM q WHERE k <= 4), l AS (SELECT i AS pid, avg(x1) AS w_x1, avg(x2) AS w_x2 FROM near JOIN t ON t.pid = j GROUP BY i),
r AS MATERIALIZED (SELECT t.pid, x1, x2, w_x1, w_x2, (x - 424000) / 10000 AS e, (y - 4618000) / 10000 AS n, {_Y.replace('pid *', 't.pid *')} AS response FROM t JOIN l ON l.pid = t.pid),
d AS MATERIALIZED (SELECT *, e * e AS ee, n * n AS nn, e * n AS en FROM r)"""
SPECS = {"plain": ["x1", "x2"], "slx": ["x1", "x2", "w_x1", "w_x2"], "trend": ["x1", "x2", "e", "n", "ee", "nn", "en"]}


def _sql_fit(xs: list[str]) -> str:
    """term, b, se, t, p, n, r2, adjusted, aic: normal equations by Gauss-Jordan elimination, p by Simpson's rule."""
    names = ["1.0", *xs]
    k = len(names)
    rows = ", ".join("[" + ", ".join([f"sum({a} * {b})::DOUBLE" for b in names] + [f"{float(i == j)}::DOUBLE" for j in range(k)]) + "]" for i, a in enumerate(names))
    step = f"list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = step + 1 THEN list_transform(a[i], lambda v: v / a[i][i]) ELSE list_transform(range(1, {2 * k + 1}), lambda c: a[i][c] - a[i][step + 1] * a[step + 1][c] / a[step + 1][step + 1]) END)"
    fitted = " + ".join(f"b[{i + 1}] * {c}" for i, c in enumerate(names))
    terms = ", ".join(f"'{c}'" for c in ["intercept", *xs])
    density = "exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * power(1 + x * x / v, -(v + 1) / 2)"
    return f"""{_RESPONSE.replace('WITH', 'WITH RECURSIVE', 1)}, m(step, a) AS (SELECT 0, [{rows}] FROM d UNION ALL SELECT step + 1, {step} FROM m WHERE step < {k}),
i AS (SELECT list_transform(a, lambda r: r[{k + 1}:]) AS inverse FROM m WHERE step = {k}), xy AS (SELECT [{', '.join(f'sum({c} * response)::DOUBLE' for c in names)}] AS v FROM d),
b AS MATERIALIZED (SELECT inverse, list_transform(inverse, lambda r: list_dot_product(r, v)) AS b FROM i, xy),
s AS (SELECT count(*) AS n, sum(power(response - ({fitted}), 2)) AS rest, var_pop(response) * count(*) AS total FROM d, b),
o AS (SELECT unnest([{terms}]) AS term, unnest(b) AS b, unnest(list_transform(range(1, {k + 1}), lambda i: inverse[i][i])) AS g FROM b),
z AS (SELECT o.term, o.b, sqrt(g * rest / (n - {k})) AS se, o.b / sqrt(g * rest / (n - {k})) AS t, n, n - {k} AS v, 1 - rest / total AS r2, 2 * {k} + n * (ln(2 * pi() * rest / n) + 1) AS aic FROM o, s),
g AS (SELECT term, greatest(0, 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density}) * any_value(h) / 3) AS p FROM (SELECT term, v, i, least(abs(t), 40) / 4000 AS h, least(abs(t), 40) * i / 4000 AS x FROM z, unnest(range(4001)) AS u(i)) GROUP BY term)
SELECT z.term, z.b, z.se, z.t, g.p, z.n, z.r2, 1 - (1 - z.r2) * (z.n - 1) / z.v AS adjusted, z.aic FROM z JOIN g USING (term)"""


def _rounded(name: str) -> str:
    return f"SELECT term, round(b, 6) AS b, round(se, 6) AS se, round(t, 3) AS t, round(p, 6) AS p, CAST(n AS BIGINT) AS n, round(r2, 6) AS r2, round(adjusted, 6) AS adjusted, round(aic, 3) AS aic FROM ({_sql_fit(SPECS[name])})"


def _fitted(spark, sf_dir, name: str):
    rows, _ = response(spark, sf_dir)
    found = regression.table_of(spark, regression.fit(rows, SPECS[name], "response"))
    return found.select("term", *[F.round(c, 6).alias(c) for c in ("b", "se")], F.round("t", 3).alias("t"), F.round("p", 6).alias("p"), "n", *[F.round(c, 6).alias(c) for c in ("r2", "adjusted")], F.round("aic", 3).alias("aic"))


@query(_rounded("plain"))
def ols_inference(spark, sf_dir):
    """Coefficients with errors, t and p, fit and AIC."""
    return _fitted(spark, sf_dir, "plain")


@query(_rounded("slx"))
def slx(spark, sf_dir):
    """The same with the neighbours' features."""
    return _fitted(spark, sf_dir, "slx")


@query(_rounded("trend"))
def trend_surface(spark, sf_dir):
    """The same with a quadratic surface of the place."""
    return _fitted(spark, sf_dir, "trend")


@query(f"""{_RESPONSE}, b_one AS (SELECT regr_slope(response, x1) AS b, regr_intercept(response, x1) AS a FROM d),
e AS (SELECT pid, response - a - b * x1 AS z FROM d, b_one), c AS (SELECT pid, z - (SELECT avg(z) FROM e) AS z FROM e),
w AS (SELECT i, avg(c.z) AS w FROM near JOIN c ON c.pid = j GROUP BY i) SELECT count(*) AS n, round(sum(c.z * w) / sum(c.z * c.z), 6) AS morans_i FROM c JOIN w ON w.i = c.pid""")
def residual_moran(spark, sf_dir):
    """Whether what a model with one feature leaves is alike among neighbours."""
    rows, near = response(spark, sf_dir)
    left = regression.residuals(rows, regression.fit(rows, ["x1"], "response"), ["x1"], "response")
    m = regression.residual_moran(left, "pid", near)
    return m.select("n", F.round("morans_i", 6).alias("morans_i"))


# ---------------------------------------------------------------- clusters of cells

ROUNDS = 12
_KS = range(2, 9)
_Z = f"{fx.with_layers('cells')}, z AS MATERIALIZED (SELECT CAST(row AS BIGINT) * 48 + col AS cell, row, col, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS zv, (n - avg(n) OVER ()) / stddev_pop(n) OVER () AS zn FROM cells)"
_START = " UNION ALL ".join(f"SELECT {k} AS k, 0 AS step, {c} AS c, (SELECT quantile_cont(zv, {(c + 0.5) / k}) FROM z) AS mv, (SELECT quantile_cont(zn, {(c + 0.5) / k}) FROM z) AS mn" for k in _KS for c in range(k))
_PICK = "SELECT k, step, cell, zv, zn, arg_min(c, (round(power(zv - mv, 2) + power(zn - mn, 2), 9), c)) AS c FROM {m}, z GROUP BY k, step, cell, zv, zn"
_KMEANS = f"""{_Z.replace('WITH', 'WITH RECURSIVE', 1)}, m(k, step, c, mv, mn) AS (({_START}) UNION ALL
  (WITH p AS ({_PICK.format(m='m')}) SELECT m.k, m.step + 1, m.c, coalesce(avg(zv), any_value(m.mv)), coalesce(avg(zn), any_value(m.mn)) FROM m LEFT JOIN p ON p.k = m.k AND p.c = m.c WHERE m.step < {ROUNDS} GROUP BY m.k, m.step, m.c)),
p AS MATERIALIZED ({_PICK.format(m=f'(SELECT * FROM m WHERE step = {ROUNDS}) m')})"""


def standard_cells(spark, sf_dir):
    c = fx.cells(spark, sf_dir).selectExpr("CAST(row AS BIGINT) * 48 + col AS cell", "row", "col", "value", "CAST(n AS DOUBLE) AS n")
    return cut(clusters.standardised(c, ["value", "n"]))


@query(f"""{_KMEANS}, s AS (SELECT k, c, count(*) AS m, avg(zv) AS mv, avg(zn) AS mn, var_pop(zv) + var_pop(zn) AS v FROM p GROUP BY k, c),
d AS (SELECT p.k, p.cell, p.c, s.c AS o, s.m, power(zv - mv, 2) + power(zn - mn, 2) AS d2, s.v FROM p JOIN s ON s.k = p.k),
w AS (SELECT k, cell, sum(d2) FILTER (o = c) AS d2, max((d2 + v) * m / nullif(m - 1, 0)) FILTER (o = c) AS a, min(d2 + v) FILTER (o <> c) AS b FROM d GROUP BY k, cell)
SELECT CAST(k AS INT) AS k, count(*) AS n, round(sum(d2), 4) AS inertia, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM w GROUP BY k""")
def kmeans_sweep(spark, sf_dir):
    """k-means of standardised cells for k from 2 to 8: inertia and silhouette."""
    z = standard_cells(spark, sf_dir)
    names = ["z_value", "z_n"]
    s = clusters.sweep(z, names, clusters.kmeans(z, names, list(_KS), ROUNDS))
    return s.select("k", "n", F.round("inertia", 4).alias("inertia"), F.round("silhouette", 6).alias("silhouette"))


@query(f"""{_KMEANS}, l AS MATERIALIZED (SELECT p.cell, p.c, z.row, z.col FROM p JOIN z USING (cell) WHERE k = 4),
e AS MATERIALIZED (SELECT a.cell AS a, b.cell AS b FROM l a JOIN l b ON a.c = b.c AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
r(cell, label) AS (SELECT cell, cell FROM l UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.cell),
f AS (SELECT c, label, count(*) AS m FROM (SELECT cell, min(label) AS label FROM r GROUP BY cell) JOIN l USING (cell) GROUP BY c, label)
SELECT CAST(c AS INT) AS cluster, CAST(sum(m) AS BIGINT) AS n, count(*) AS parts, max(m) AS largest FROM f GROUP BY c""")
def cluster_fragments(spark, sf_dir):
    """Into how many connected parts each of four clusters of cells falls."""
    z = standard_cells(spark, sf_dir)
    names = ["z_value", "z_n"]
    l = cut(clusters.labelled(z, names, clusters.kmeans(z, names, [4], ROUNDS)[4]))  # noqa: E741
    step = F.array(F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit(1).alias("r"), F.lit(0).alias("c")))
    ahead = l.select(F.col("cell").alias("a"), "row", "col", F.explode(step).alias("s")).select("a", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    edges = ahead.join(l.select("row", "col", F.col("cell").alias("b")), ["row", "col"]).select("a", "b")
    return clusters.fragments(l, "cell", edges).select("cluster", "n", "parts", "largest")


# ---------------------------------------------------------------- weighted draws

_U = "(CAST(o_orderkey * 7919 % 100003 AS DOUBLE) + 0.5) / 100003"


@query(f"""WITH w AS (SELECT c_custkey AS pid, greatest(0, floor(c_acctbal)) AS weight FROM customer), s AS (SELECT pid, sum(weight) OVER (ORDER BY pid) - weight AS lo, sum(weight) OVER (ORDER BY pid) AS hi, sum(weight) OVER () AS whole FROM w),
d AS (SELECT o_orderkey AS draw, {_U} AS u FROM orders) SELECT draw, pid FROM d JOIN s ON u * whole >= lo AND u * whole < hi""")
def weighted_controls(spark, sf_dir):
    """A control for every order, drawn among customers by their balance."""
    w = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS pid", "greatest(0, floor(c_acctbal)) AS weight")
    d = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS draw", f"{_U} AS u")
    return sampling.drawn(sampling.prefix_sums(w, "pid", "weight"), d).select("draw", "pid")
