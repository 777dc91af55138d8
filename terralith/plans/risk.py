"""Registered queries of risk, networks and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.functions import geometry
from terralith.operators import risk, spatial_join
from terralith.plans.analysis import reach
from terralith.plans.registry import Registry, r4
from terralith.plans.spatial import inside
from terralith.sources import fixtures as fx
from terralith.sources import layers
from terralith.sources.fixtures import table

queries = Registry()
query = queries.add

#: Water levels in metres by return period, and the knots of the depth-damage curve.
LEVELS = {2: 0.4, 5: 0.9, 10: 1.4, 50: 2.3, 100: 2.9, 500: 3.8}
CURVE = [(0.0, 0.0), (0.5, 0.2), (1.5, 0.6), (3.0, 1.0)]
RISE, RATE, YEARS = 0.3, 0.03, 30


def _with(*names: str) -> str:
    return "WITH " + ",\n".join((layers.SQL | fx.SQL)[n] for n in names)


def buildings(spark, sf_dir):
    """Parcels with a value, the height they stand at and the district their centre lies in."""
    p = layers.parcels(spark, sf_dir).selectExpr("parcel_id", "(xmin + xmax) / 2 AS x", "(ymin + ymax) / 2 AS y", "(parcel_id % 40) / 10 AS ground")
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("parcel_id"), F.col("p_retailprice").alias("value"))
    return spatial_join.join_within(p, fx.districts(spark, sf_dir), inside()).join(v, "parcel_id")


_SHARE = "CASE WHEN d <= 0 THEN 0 WHEN d <= 0.5 THEN d * 0.4 WHEN d <= 1.5 THEN 0.2 + (d - 0.5) * 0.4 WHEN d <= 3 THEN 0.6 + (d - 1.5) * 0.4 / 1.5 ELSE 1 END"
_BUILDINGS = """b AS (SELECT d.district_id, parcel_id, (parcel_id % 40) / 10 AS ground, p_retailprice AS value FROM parcels JOIN part ON p_partkey = parcel_id
  JOIN districts d ON (parcels.xmin + parcels.xmax) / 2 >= d.xmin AND (parcels.xmin + parcels.xmax) / 2 < d.xmax AND (parcels.ymin + parcels.ymax) / 2 >= d.ymin AND (parcels.ymin + parcels.ymax) / 2 < d.ymax)"""
_T = "t(period, level) AS (VALUES " + ", ".join(f"({p}, {v}::DOUBLE)" for p, v in LEVELS.items()) + ")"


def _losses(name: str, level: str, factor: str) -> str:
    return f"""{name} AS (SELECT district_id, period, sum(value * least(1, {factor} * ({_SHARE}))) AS loss FROM (SELECT b.*, period, CAST({level} - ground AS DOUBLE) AS d FROM b, t) GROUP BY ALL),
{name}_ead AS (SELECT district_id, sum((loss + next) / 2 * (1.0::DOUBLE / period - 1.0::DOUBLE / later)) AS ead FROM (SELECT *, lead(loss) OVER w AS next, lead(period) OVER w AS later FROM {name} WINDOW w AS (PARTITION BY district_id ORDER BY period)) WHERE later IS NOT NULL GROUP BY 1)"""


@query(f"""{_with('parcels', 'districts')}, {_BUILDINGS}, {_T}, {_losses('now', 'level', '1.0')}, {_losses('later', f'level + {RISE}', '1.0')}, {_losses('hard', 'level', '1.2')}
SELECT district_id, round(a.ead, 4) AS expected, round(b.ead, 4) AS with_rise, round(c.ead, 4) AS harder_damage, round(a.ead * (1 - power(1 + {RATE}::DOUBLE, -{YEARS})) / {RATE}::DOUBLE, 3) AS present_value
FROM now_ead a JOIN later_ead b USING (district_id) JOIN hard_ead c USING (district_id)""")
def expected_annual_damage(spark, sf_dir):
    """Trapezoids over the chances of six return periods, by district: today, with higher water, with a harder
    curve, and the present value of 30 years."""
    b = buildings(spark, sf_dir)
    ead = lambda name, rise, factor: risk.expected_annual(b, "district_id", {p: v + rise for p, v in LEVELS.items()}, CURVE, factor).withColumnRenamed("ead", name)
    all_ = ead("now", 0.0, 1.0).join(ead("later", RISE, 1.0), "district_id").join(ead("hard", 0.0, 1.2), "district_id")
    pv = F.col("now") * risk.present_value_factor(RATE, YEARS)
    return all_.select("district_id", r4(F.col("now"), "expected"), r4(F.col("later"), "with_rise"), r4(F.col("hard"), "harder_damage"), F.round(pv, 3).alias("present_value"))


@query(f"""{_with('parcels', 'districts')}, {_BUILDINGS}, {_T} SELECT CAST(period AS INTEGER) AS period, count(*) FILTER (level > ground) AS n_wet, round(sum(value * ({_SHARE.replace('d ', '(level - ground) ').replace('(d ', '((level - ground) ')})), 2) AS loss FROM b, t GROUP BY period""")
def loss_by_period(spark, sf_dir):
    """Buildings that get wet and the loss, at each return period."""
    loss = risk.losses(buildings(spark, sf_dir), LEVELS, CURVE)
    return loss.groupBy("period").agg(F.count_if(F.col("depth") > 0).alias("n_wet"), F.round(F.sum("loss"), 2).alias("loss"))


_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@query(f"""{_with('points').replace('WITH', 'WITH RECURSIVE', 1)}, p AS (SELECT x, y, max(kind = 'SUPPLIER') AS source, x * 100000 + y AS node FROM points GROUP BY x, y),
e AS (SELECT a.node AS a, b.node AS b, sqrt({_D2}) AS w FROM p a JOIN p b ON a.node <> b.node AND {_D2} <= 2250000),
r(node, d) USING KEY (node) AS (SELECT node, 0.0::DOUBLE FROM p WHERE source
  UNION SELECT e.b, min(r.d + e.w) FROM r JOIN e ON e.a = r.node LEFT JOIN recurring.r AS k ON k.node = e.b WHERE r.d + e.w < coalesce(k.d, 'inf'::DOUBLE) GROUP BY e.b),
s AS (SELECT a.node, sqrt(min({_D2})) AS s FROM p a JOIN p b ON b.source WHERE NOT a.source GROUP BY 1)
SELECT CAST(floor(s / 1000) AS INTEGER) AS km, count(*) AS n, count(r.node) AS n_reached, round(avg(r.d / s), 6) AS detour FROM s LEFT JOIN r USING (node) GROUP BY 1""")
def network_detour(spark, sf_dir):
    """Network distance over straight distance to the nearest supplier, by straight distance; who isn't reached at all."""
    points = fx.points(spark, sf_dir)
    p = points.groupBy("x", "y").agg(F.max(F.col("kind") == "SUPPLIER").alias("source")).withColumn("node", F.col("x") * 100000 + F.col("y"))
    rest, sources = p.where("NOT source").select("node", "x", "y"), p.where("source").select("node", "x", "y")
    s = spatial_join.nearest(rest, sources, "node", "node", 1, 2000.0).select("node", F.sqrt("d2").alias("s"))
    d = s.join(reach(points).select("node", "distance"), "node", "left")
    return d.groupBy(F.floor(F.col("s") / 1000).cast("int").alias("km")).agg(F.count("*").alias("n"), F.count("distance").alias("n_reached"), F.round(F.avg(F.col("distance") / F.col("s")), 6).alias("detour"))


@query(f"""{_with('parcels', 'districts')}, a AS (SELECT district_id, count(*) AS n, sum((p.xmax - p.xmin) * (p.ymax - p.ymin)) AS whole FROM parcels p JOIN districts d ON (p.xmin + p.xmax) / 2 >= d.xmin AND (p.xmin + p.xmax) / 2 < d.xmax AND (p.ymin + p.ymax) / 2 >= d.ymin AND (p.ymin + p.ymax) / 2 < d.ymax GROUP BY 1),
s AS (SELECT district_id, sum((least(p.xmax, d.xmax) - greatest(p.xmin, d.xmin)) * (least(p.ymax, d.ymax) - greatest(p.ymin, d.ymin))) AS shared FROM parcels p JOIN districts d ON p.xmin < d.xmax AND p.xmax > d.xmin AND p.ymin < d.ymax AND p.ymax > d.ymin GROUP BY 1)
SELECT district_id, n, round(whole, 3) AS by_centroid, round(shared, 3) AS by_area, round(whole / shared - 1, 6) AS error FROM a JOIN s USING (district_id)""")
def centroid_assignment(spark, sf_dir):
    """Area that districts get when parcels go whole to where their centroid lies, against exact shares."""
    p = layers.with_ring(layers.parcels(spark, sf_dir))
    c = geometry.centroid(F.col("ring"))
    at = p.select("parcel_id", c["x"].alias("x"), c["y"].alias("y"), geometry.area(F.col("ring")).alias("area"))
    a = spatial_join.join_within(at, fx.districts(spark, sf_dir), inside()).groupBy("district_id").agg(F.count("*").alias("n"), F.sum("area").alias("whole"))
    m = spatial_join.pairs(p, layers.with_ring(fx.districts(spark, sf_dir)), 4000.0)
    s = m.groupBy(F.col("r_district_id").alias("district_id")).agg(F.sum(geometry.area(geometry.clip_convex(F.col("ring"), F.col("r_ring")))).alias("shared"))
    return a.join(s, "district_id").select("district_id", "n", F.round("whole", 3).alias("by_centroid"), F.round("shared", 3).alias("by_area"), F.round(F.col("whole") / F.col("shared") - 1, 6).alias("error"))
