"""Registered queries over geometry, graphs, point patterns and statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terralith.functions import geometry
from terralith.operators import graph, patterns, raster, spatial_join, statistics
from terralith.plans.spatial import _IN, _OCTAGON, _ZONES, in_octagon, inside, r4
from terralith.sources import fixtures as fx
from terralith.sources.fixtures import table, with_layers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def customers(spark, sf_dir):
    return fx.points(spark, sf_dir).where("kind <> 'SUPPLIER'")


def suppliers(spark, sf_dir):
    return fx.points(spark, sf_dir).where("kind = 'SUPPLIER'")


_C = f"{with_layers('points')}, c AS (SELECT * FROM points WHERE kind <> 'SUPPLIER'), s AS (SELECT * FROM points WHERE kind = 'SUPPLIER')"
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@query(f"{_C} SELECT pid, round(32 * sin(2 * pi() / 64) * power(100.0 + pid % 400, 2), 3) AS area, round(128 * sin(pi() / 64) * (100.0 + pid % 400), 3) AS perimeter FROM s")
def buffer_suppliers(spark, sf_dir):
    """Discs of 64 vertices with a radius of each row's own."""
    ring = geometry.buffer_point(F.col("x"), F.col("y"), 100.0 + F.col("pid") % 400)
    s = suppliers(spark, sf_dir).select("pid", ring.alias("ring"))
    return s.select("pid", F.round(geometry.area(F.col("ring")), 3).alias("area"), F.round(geometry.perimeter(F.col("ring")), 3).alias("perimeter"))


_SHIFTED = ["xmin + 4000 AS g_xmin", "ymin + 4500 AS g_ymin", "xmax + 4000 AS g_xmax", "ymax + 4500 AS g_ymax"]


@query(f"""{with_layers('districts')}, {_ZONES}, g AS (SELECT district_id AS box_id, {', '.join(_SHIFTED)} FROM districts)
SELECT zone_id, box_id, round((least(xmax, g_xmax) - greatest(xmin, g_xmin)) * (least(ymax, g_ymax) - greatest(ymin, g_ymin)) - 2000000, 3) AS area
FROM zones, g WHERE xmin < g_xmax AND g_xmin < xmax AND ymin < g_ymax AND g_ymin < ymax""")
def overlay_zones(spark, sf_dir):
    """Intersection of octagons and boxes: pairs by grid cell, each in the cell of its lower left corner, then clipped."""
    z = spatial_join.cover(fx.zones(spark, sf_dir), 4000.0)
    g = fx.districts(spark, sf_dir).selectExpr("district_id AS box_id", "xmin + 4000 AS xmin", "ymin + 4500 AS ymin", "xmax + 4000 AS xmax", "ymax + 4500 AS ymax")
    g = spatial_join.cover(g, 4000.0).select("box_id", *[F.col(c).alias(f"g_{c}") for c in ("xmin", "ymin", "xmax", "ymax")], "cx", "cy")
    once = (F.col("cx") == spatial_join.cell(F.greatest("xmin", "g_xmin"), 4000.0)) & (F.col("cy") == spatial_join.cell(F.greatest("ymin", "g_ymin"), 4000.0))
    part = geometry.clip_convex(F.col("ring"), geometry.box(*[F.col(f"g_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]))
    parts = z.join(g, ["cx", "cy"]).where(once).select("zone_id", "box_id", part.alias("part")).where(F.size("part") > 2)
    return parts.select("zone_id", "box_id", F.round(geometry.area(F.col("part")), 3).alias("area")).where("area > 0")


@query(f"""{with_layers('districts')}, d AS (SELECT district_id % 3 AS grp, * FROM districts),
e AS (SELECT grp, xmin AS ax, ymin AS ay, xmax AS bx, ymin AS b_y FROM d UNION ALL SELECT grp, xmin, ymax, xmax, ymax FROM d UNION ALL SELECT grp, xmin, ymin, xmin, ymax FROM d UNION ALL SELECT grp, xmax, ymin, xmax, ymax FROM d),
o AS (SELECT grp, ax, ay, bx, b_y FROM e GROUP BY ALL HAVING count(*) = 1)
SELECT o.grp, count(*) AS n_edges, round(sum(abs(bx - ax) + abs(b_y - ay)), 3) AS perimeter, any_value(a.area) AS area
FROM o JOIN (SELECT grp, round(sum((xmax - xmin) * (ymax - ymin)), 3) AS area FROM d GROUP BY grp) a ON a.grp = o.grp GROUP BY o.grp""")
def dissolve_districts(spark, sf_dir):
    """Outline of each group of a tessellation: an edge that two members share cancels out (a column's four districts touch)."""
    d = fx.districts(spark, sf_dir).withColumn("grp", F.col("district_id") % 3).withColumn("ring", geometry.box(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))
    e = d.select("grp", F.explode(geometry.edges(F.col("ring"))).alias("e")).select("grp", *[F.struct(F.col(f"e.{s}x").alias("x"), F.col(f"e.{s}y").alias("y")).alias(p) for s, p in (("a", "p"), ("b", "q"))])
    outer = e.groupBy("grp", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.count("*").alias("m")).where("m = 1")
    long = F.sqrt(F.expr("(q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)"))
    total = d.groupBy("grp").agg(F.round(F.sum(geometry.area(F.col("ring"))), 3).alias("area"))
    return outer.groupBy("grp").agg(F.count("*").alias("n_edges"), F.round(F.sum(long), 3).alias("perimeter")).join(total, "grp")


@query(f"{with_layers('points', 'districts')}, {_ZONES} SELECT kind, count(*) AS n_outside, round(avg(weight), 4) AS mean_weight FROM points p WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE {_OCTAGON}) GROUP BY kind")
def outside_zones(spark, sf_dir):
    """Spatial anti join."""
    p = fx.points(spark, sf_dir)
    hit = spatial_join.join_within(p, fx.zones(spark, sf_dir), in_octagon()).select("kind", "pid").distinct()
    return p.join(hit, ["kind", "pid"], "left_anti").groupBy("kind").agg(F.count("*").alias("n_outside"), r4(F.avg("weight"), "mean_weight"))


@query(f"""{_C.replace('WITH', 'WITH RECURSIVE', 1)}, n AS (SELECT a.pid, b.pid AS q FROM c a JOIN c b ON {_D2} <= 1440000),
core AS (SELECT pid FROM n GROUP BY pid HAVING count(*) >= 4), e AS (SELECT n.* FROM n JOIN core USING (pid)), f AS (SELECT e.pid, e.q FROM e JOIN core k ON k.pid = e.q),
r(pid, label) AS (SELECT pid, pid FROM core UNION SELECT f.q, r.label FROM r JOIN f ON f.pid = r.pid), l AS (SELECT pid, min(label) AS label FROM r GROUP BY pid)
SELECT c.pid, l.label IS NOT NULL AS core, coalesce(l.label, (SELECT min(l2.label) FROM e JOIN l l2 ON l2.pid = e.pid WHERE e.q = c.pid)) AS cluster FROM c LEFT JOIN l ON l.pid = c.pid""")
def cluster_customers(spark, sf_dir):
    return patterns.dbscan(customers(spark, sf_dir), 1200.0, 4)


@query(f"""{_C}, p AS (SELECT a.pid, b.pid AS q, greatest(b.weight, 0) AS cap, exp(-2 * ({_D2}) / 25000000.0) AS g FROM c a JOIN s b ON {_D2} <= 25000000),
r AS (SELECT q, max(cap) / sum(g) AS rate FROM p GROUP BY q), t AS (SELECT p.pid, sum(rate * g) AS access FROM p JOIN r USING (q) GROUP BY p.pid)
SELECT c.pid, round(coalesce(access, 0), 4) AS access FROM c LEFT JOIN t ON t.pid = c.pid""")
def two_step_access(spark, sf_dir):
    """Floating catchments: balances of suppliers shared among the customers within 5 km."""
    c = customers(spark, sf_dir).select("pid", "x", "y", F.lit(1.0).alias("weight"))
    s = suppliers(spark, sf_dir).select("pid", "x", "y", F.greatest("weight", F.lit(0.0)).alias("weight"))
    return patterns.two_step_access(c, s, 5000.0).select("pid", r4(F.col("access"), "access"))


@query(f"{_C} SELECT CAST(floor(sqrt({_D2}) / 500) AS INT) AS lag, count(*) AS pairs, round(avg(power(a.weight - b.weight, 2)) / 2, 2) AS gamma FROM c a JOIN c b ON a.pid < b.pid AND {_D2} <= 9000000 GROUP BY 1")
def semivariogram(spark, sf_dir):
    return patterns.semivariogram(customers(spark, sf_dir), 500.0, 3000.0).select("lag", "pairs", F.round("gamma", 2).alias("gamma"))


@query(f"""{_C}, d AS (SELECT a.pid, sqrt(min({_D2})) AS d FROM c a JOIN c b ON a.pid <> b.pid GROUP BY a.pid), m AS (SELECT count(*) AS n, avg(d) AS o, 0.5 * sqrt(1728000000.0 / count(*)) AS e FROM d)
SELECT n, round(o, 4) AS observed, round(e, 4) AS expected, round(o / e, 5) AS ratio, round((o - e) / (0.26136 / sqrt(n * n / 1728000000.0)), 4) AS z FROM m""")
def nearest_neighbour_index(spark, sf_dir):
    r = patterns.clark_evans(customers(spark, sf_dir), 1_728_000_000.0, 1000.0)
    return r.select("n", r4(F.col("observed"), "observed"), r4(F.col("expected"), "expected"), F.round("ratio", 5).alias("ratio"), r4(F.col("z"), "z"))


@query(f"""{_C}, g AS (SELECT i.range AS i, j.range AS j FROM range(100, 112) i, range(1150, 1159) j), n AS (SELECT g.i, g.j, count(c.pid) AS n FROM g LEFT JOIN c ON floor(c.x / 4000) = g.i AND floor(c.y / 4000) = g.j GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n, round(var_samp(n) / avg(n), 5) AS vmr, round(var_samp(n) * 107 / avg(n), 4) AS chi2 FROM n""")
def quadrat_test(spark, sf_dir):
    return patterns.quadrats(customers(spark, sf_dir), 4000.0, 108).select("n", F.round("vmr", 5).alias("vmr"), r4(F.col("chi2"), "chi2"))


_LEG = "b{n} AS (SELECT node, min(d) AS d FROM (SELECT * FROM b{m} UNION ALL SELECT e.b, b{m}.d + e.w FROM b{m} JOIN e ON e.a = b{m}.node) GROUP BY node)"


@query(f"""{_C}, p AS (SELECT row_number() OVER () AS k, x, y, max(kind = 'SUPPLIER') AS source, x * 100000 + y AS node FROM points GROUP BY x, y),
e AS (SELECT a.node AS a, b.node AS b, sqrt({_D2}) AS w FROM p a JOIN p b ON a.node <> b.node AND {_D2} <= 2250000), b0 AS (SELECT node, 0.0::DOUBLE AS d FROM p WHERE source),
{', '.join(_LEG.format(n=k + 1, m=k) for k in range(4))} SELECT CAST(floor(d / 500) AS INT) AS ring, count(*) AS n, round(avg(d), 3) AS mean_m FROM b4 GROUP BY 1""")
def network_reach(spark, sf_dir):
    """Distance from the nearest supplier along legs of up to 1.5 km between points, four legs at most."""
    return rings(reach(fx.points(spark, sf_dir), legs=4))


def reach(points, legs=None):
    """node (a place), distance from the nearest supplier's place over legs of up to 1.5 km."""
    p = points.groupBy("x", "y").agg(F.max(F.col("kind") == "SUPPLIER").alias("source")).withColumn("node", F.col("x") * 100000 + F.col("y"))
    q = p.select("node", "x", "y")
    e = graph.cut(spatial_join.join_near(q, q, 1500.0).where("node <> r_node").select(F.col("node").alias("a"), F.col("r_node").alias("b"), F.sqrt("d2").alias("w")))
    return graph.shortest_paths(e, p.where("source").select("node"), legs=legs)


def rings(d):
    return d.groupBy(F.floor(F.col("distance") / 500).cast("int").alias("ring")).agg(F.count("*").alias("n"), F.round(F.avg("distance"), 3).alias("mean_m"))


@query(f"""{_C.replace('WITH', 'WITH RECURSIVE', 1)}, p AS (SELECT x, y, max(kind = 'SUPPLIER') AS source, x * 100000 + y AS node FROM points GROUP BY x, y),
e AS (SELECT a.node AS a, b.node AS b, sqrt({_D2}) AS w FROM p a JOIN p b ON a.node <> b.node AND {_D2} <= 2250000),
r(node, d) USING KEY (node) AS (SELECT node, 0.0::DOUBLE FROM p WHERE source
  UNION SELECT e.b, min(r.d + e.w) FROM r JOIN e ON e.a = r.node LEFT JOIN recurring.r AS k ON k.node = e.b WHERE r.d + e.w < coalesce(k.d, 'inf'::DOUBLE) GROUP BY e.b)
SELECT CAST(floor(d / 500) AS INT) AS ring, count(*) AS n, round(avg(d), 3) AS mean_m FROM r GROUP BY 1""")
def network_reach_all(spark, sf_dir):
    """network_reach to the end: every point that any number of legs leads to."""
    return rings(reach(fx.points(spark, sf_dir)))


@query(f"{with_layers('cells')} SELECT CAST(floor(row / 3) AS INT) AS row, CAST(floor(col / 3) AS INT) AS col, round(avg(value), 4) AS value, count(value) AS n_cells FROM cells GROUP BY ALL")
def resample_blocks(spark, sf_dir):
    return raster.block_mean(fx.cells(spark, sf_dir), 3).select("row", "col", r4(F.col("value"), "value"), "n_cells")


@query(f"""{with_layers('cells').replace('WITH', 'WITH RECURSIVE', 1)}, h AS (SELECT CAST(row AS BIGINT) * 48 + col AS node, row, col, value FROM cells WHERE value > 180),
e AS (SELECT a.node AS a, b.node AS b FROM h a JOIN h b ON abs(a.row - b.row) + abs(a.col - b.col) = 1), r(node, label) AS (SELECT node, node FROM h UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node),
l AS (SELECT node, min(label) AS patch FROM r GROUP BY node) SELECT patch, count(*) AS n_cells, round(avg(value), 4) AS mean_value FROM l JOIN h USING (node) GROUP BY patch HAVING count(*) >= 3""")
def candidate_patches(spark, sf_dir):
    """4-connected regions of cells above a threshold, those of three cells or more."""
    c = raster.patches(fx.cells(spark, sf_dir).where("value > 180"), 48)
    return c.groupBy("patch").agg(F.count("*").alias("n_cells"), r4(F.avg("value"), "mean_value")).where("n_cells >= 3")


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def rank_correlation(spark, sf_dir):
    return statistics.spearman(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_discount").select("l_returnflag", "n", F.round("rho", 6).alias("rho"))


@query("""WITH m AS (SELECT l_linestatus, count(*) AS n, var_pop(l_quantity) AS a, var_pop(l_discount) AS b, covar_pop(l_quantity, l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS d, covar_pop(l_discount, l_extendedprice) AS e,
  avg(l_quantity) AS u, avg(l_discount) AS v, avg(l_extendedprice) AS w FROM lineitem GROUP BY 1), s AS (SELECT *, (d * b - e * c) / (a * b - c * c) AS b1, (e * a - d * c) / (a * b - c * c) AS b2 FROM m)
SELECT l_linestatus, n, round(w - b1 * u - b2 * v, 2) AS b0, round(b1, 3) AS b1, round(b2, 2) AS b2 FROM s""")
def regress_two(spark, sf_dir):
    r = statistics.two_regressors(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_quantity", "l_discount", "l_extendedprice")
    return r.select("l_linestatus", "n", F.round("b0", 2).alias("b0"), F.round("b1", 3).alias("b1"), F.round("b2", 2).alias("b2"))


@query("""SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS low, round(quantile_cont(c_acctbal, 0.25), 4) AS q1,
  round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.75), 4) AS q3, max(c_acctbal) AS high FROM customer GROUP BY 1""")
def describe_balances(spark, sf_dir):
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count(b).alias("n"), r4(F.avg(b), "mean"), r4(F.stddev_samp(b), "std"), F.min(b).alias("low"), *[r4(F.percentile(b, q), name) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))], F.max(b).alias("high")
    )


@query("""SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_balances(spark, sf_dir):
    """Nations, regions and the whole in one pass."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, sum(1000 + s_suppkey % 500) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS spent FROM supplier)
SELECT s_nationkey, s_suppkey, CAST(spent AS BIGINT) AS spent FROM r WHERE spent <= 5000""")
def budget_cut(spark, sf_dir):
    """The best suppliers of each nation whose running cost stays within a budget."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.sum(1000 + F.col("s_suppkey") % 500).over(w).alias("spent"))
    return s.where("spent <= 5000")


@query(f"""{with_layers('points', 'districts')}, t AS (SELECT d.district_id, count(*) AS n, count(*) FILTER (p.weight < 0) AS k FROM districts d JOIN points p ON {_IN} GROUP BY 1),
m AS (SELECT sum(k) / sum(n) AS m, avg(n) AS nb FROM t), v AS (SELECT m, nb, greatest(0, (SELECT sum(n * power(k / n - m, 2)) / sum(n) FROM t) - m / nb) AS v FROM m)
SELECT district_id, n, round(k / n, 6) AS raw, round(m + v / nullif(v + m / n, 0) * (k / n - m), 6) AS smoothed FROM t, v""")
def smooth_rates(spark, sf_dir):
    """Empirical Bayes: the share of negative balances in each district, drawn to the whole's where it has few points."""
    t = spatial_join.join_within(fx.points(spark, sf_dir), fx.districts(spark, sf_dir), inside()).groupBy("district_id").agg(F.count("*").alias("n"), F.count_if(F.col("weight") < 0).alias("k"))
    m = t.agg((F.sum("k") / F.sum("n")).alias("m"), F.avg("n").alias("nb"))
    gap = F.expr("n * power(k / n - m, 2)")
    v = t.join(F.broadcast(m)).agg((F.sum(gap) / F.sum("n")).alias("s"), F.max("m").alias("m"), F.max("nb").alias("nb")).selectExpr("m", "greatest(0, s - m / nb) AS v")
    return t.join(F.broadcast(v)).selectExpr("district_id", "n", "round(k / n, 6) AS raw", "round(m + v / nullif(v + m / n, 0) * (k / n - m), 6) AS smoothed")
