"""Registered queries over cell tables: terrain, bands, alignment, zones of polygons, distances, constraints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terralith.functions import geometry, polygons
from terralith.operators import raster, spatial_join
from terralith.plans.registry import Registry, r4
from terralith.plans.spatial import _ZONES
from terralith.sources import fixtures as fx
from terralith.sources import layers

queries = Registry()
query = queries.add

SIZE = 1000
#: Centre and bounds of a cell; row 0 is the northernmost.
_X, _Y = f"({fx.X0} + col * {SIZE} + 500.0)", f"({fx.Y0} + (35 - row) * {SIZE} + 500.0)"


def _with(*names: str) -> str:
    return "WITH " + ",\n".join((layers.SQL | fx.SQL)[n] for n in names)


def centres(spark, sf_dir):
    """Cells with their centre (x, y) and number."""
    return fx.cells(spark, sf_dir).selectExpr("row", "col", "value", "n", f"CAST({_X} AS DOUBLE) AS x", f"CAST({_Y} AS DOUBLE) AS y", "CAST(row AS BIGINT) * 48 + col AS cell")


_CENTRES = f"centres AS (SELECT row, col, value, n, CAST({_X} AS DOUBLE) AS x, CAST({_Y} AS DOUBLE) AS y, CAST(row AS BIGINT) * 48 + col AS cell FROM cells)"
_HELD = """c.x > z.xmin AND c.x < z.xmax AND c.y > z.ymin AND c.y < z.ymax AND (c.x - z.xmin) + (c.y - z.ymin) > 2000 AND (z.xmax - c.x) + (c.y - z.ymin) > 2000
  AND (c.x - z.xmin) + (z.ymax - c.y) > 2000 AND (z.xmax - c.x) + (z.ymax - c.y) > 2000"""


@query(f"""{_with('cells', 'districts')}, {_ZONES}, {_CENTRES}
SELECT z.zone_id, count(*) AS n_cells, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, round(stddev_pop(value), 4) AS spread, round(100.0 * count(*) FILTER (value >= 240) / count(*), 4) AS pct_high
FROM centres c JOIN zones z ON {_HELD} GROUP BY z.zone_id""")
def zonal_polygons(spark, sf_dir):
    """Statistics of the cells whose centre lies in the interior of each polygon, and the share of one class."""
    inside = F.expr("x > xmin AND x < xmax AND y > ymin AND y < ymax") & (polygons.locate(F.col("ring"), F.col("x"), F.col("y")) == "I")
    m = spatial_join.join_within(centres(spark, sf_dir), fx.zones(spark, sf_dir), inside)
    v = F.col("value")
    return m.groupBy("zone_id").agg(
        F.count("*").alias("n_cells"), r4(F.avg(v), "mean"), F.min(v).alias("low"), F.max(v).alias("high"), r4(F.stddev_pop(v), "spread"), r4(100.0 * F.count_if(v >= 240) / F.count("*"), "pct_high")
    )


_TOUCH = """x - 500 < z.xmax AND x + 500 > z.xmin AND y - 500 < z.ymax AND y + 500 > z.ymin AND (x + 500 - z.xmin) + (y + 500 - z.ymin) > 2000 AND (z.xmax - x + 500) + (y + 500 - z.ymin) > 2000
  AND (x + 500 - z.xmin) + (z.ymax - y + 500) > 2000 AND (z.xmax - x + 500) + (z.ymax - y + 500) > 2000"""


@query(f"{_with('cells', 'districts')}, {_ZONES}, {_CENTRES} SELECT z.zone_id, count(*) AS n_touched, CAST(sum(value) AS DOUBLE) AS total FROM centres c JOIN zones z ON {_TOUCH} GROUP BY z.zone_id")
def zonal_all_touched(spark, sf_dir):
    """Cells that share any area with each polygon."""
    c = centres(spark, sf_dir).selectExpr("cell", "value", "x - 500 AS xmin", "y - 500 AS ymin", "x + 500 AS xmax", "y + 500 AS ymax")
    m = spatial_join.pairs(layers.with_ring(c), fx.zones(spark, sf_dir), 4000.0)
    m = m.where(geometry.area(geometry.clip_convex(F.col("ring"), F.col("r_ring"))) > 0)
    return m.groupBy(F.col("r_zone_id").alias("zone_id")).agg(F.count("*").alias("n_touched"), F.sum("value").alias("total"))


@query(f"""{_with('cells', 'parcels')}, {_CENTRES}, h AS (SELECT p.parcel_id, count(*) AS n, avg(c.value) AS v FROM parcels p JOIN centres c ON c.x >= p.xmin AND c.x < p.xmax AND c.y >= p.ymin AND c.y < p.ymax GROUP BY 1)
SELECT p.parcel_id, h.n IS NULL AS fallback, round(coalesce(h.v, f.value), 4) AS value FROM parcels p LEFT JOIN h USING (parcel_id)
LEFT JOIN cells f ON f.col = CAST(floor(((p.xmin + p.xmax) / 2 - 400000) / 1000) AS INT) AND f.row = 35 - CAST(floor(((p.ymin + p.ymax) / 2 - 4600000) / 1000) AS INT)""")
def small_zones(spark, sf_dir):
    """Zones smaller than a cell hold no centre: they take the value of the cell their own centre lies in."""
    p = layers.parcels(spark, sf_dir)
    inside = F.expr("x >= xmin AND x < xmax AND y >= ymin AND y < ymax")
    held = spatial_join.join_within(centres(spark, sf_dir), p, inside, 1000.0).groupBy("parcel_id").agg(F.avg("value").alias("v"))
    p = p.selectExpr("parcel_id", "CAST(floor(((xmin + xmax) / 2 - 400000) / 1000) AS INT) AS col", "35 - CAST(floor(((ymin + ymax) / 2 - 4600000) / 1000) AS INT) AS row")
    p = p.join(fx.cells(spark, sf_dir).select("row", "col", "value"), ["row", "col"], "left").join(held, "parcel_id", "left")
    return p.select("parcel_id", F.col("v").isNull().alias("fallback"), r4(F.coalesce("v", "value"), "value"))


_AROUND = "JOIN cells w ON w.row = c.row AND w.col = c.col - 1 JOIN cells e ON e.row = c.row AND e.col = c.col + 1 JOIN cells s ON s.row = c.row + 1 AND s.col = c.col JOIN cells n ON n.row = c.row - 1 AND n.col = c.col"


@query(f"""{_with('cells')}, g AS (SELECT c.row, c.col, (e.value - w.value) / 20 AS gx, (n.value - s.value) / 20 AS gy, e.value + w.value + n.value + s.value - 4 * c.value AS lap FROM cells c {_AROUND}),
a AS (SELECT *, atan(sqrt(gx * gx + gy * gy)) AS slope, atan2(-gx, -gy) AS aspect FROM g)
SELECT row, col, round(degrees(slope), 4) AS slope_deg, round(CASE WHEN gx <> 0 OR gy <> 0 THEN degrees(aspect) + CASE WHEN aspect < 0 THEN 360 ELSE 0 END END, 4) AS aspect_deg,
  round(255 * greatest(0, sin(radians(45)) * cos(slope) + cos(radians(45)) * sin(slope) * cos(radians(315) - aspect)), 3) AS hillshade, CAST(lap AS DOUBLE) AS curvature FROM a""")
def terrain_surface(spark, sf_dir):
    """Central differences: slope, aspect from north, light from the north-west at 45 degrees, Laplacian."""
    g = raster.differences(fx.cells(spark, sf_dir)).selectExpr("row", "col", "(east - west) / 20 AS gx", "(north - south) / 20 AS gy", "east + west + north + south - 4 * value AS curvature")
    slope, aspect = raster.slope_aspect(F.col("gx"), F.col("gy"))
    a = g.select("*", slope.alias("slope"), aspect.alias("aspect"))
    degrees = F.degrees("aspect") + F.when(F.col("aspect") < 0, 360).otherwise(0)
    flat = (F.col("gx") == 0) & (F.col("gy") == 0)
    return a.select("row", "col", r4(F.degrees("slope"), "slope_deg"), r4(F.when(~flat, degrees), "aspect_deg"), F.round(raster.hillshade(F.col("slope"), F.col("aspect"), 315.0, 45.0), 3).alias("hillshade"), "curvature")


@query(f"{_with('cells')} SELECT row, col, round((value - 10 * n) / nullif(value + 10 * n, 0), 6) AS ndvi FROM cells")
def band_ratio(spark, sf_dir):
    """Normalised difference of two bands, null where both are 0."""
    return fx.cells(spark, sf_dir).select("row", "col", F.round(raster.normalised_difference(F.col("value"), 10 * F.col("n")), 6).alias("ndvi"))


_LAPS = "(least(1000 * (c.{i} + 1), 1500 * (t.{i} + 1)) - greatest(1000 * c.{i}, 1500 * t.{i}))"


@query(f"""{_with('cells')}, t AS (SELECT r.range AS row, c.range AS col FROM range(0, 24) r, range(0, 32) c),
o AS (SELECT CAST(t.row AS INTEGER) AS row, CAST(t.col AS INTEGER) AS col, c.value, {_LAPS.format(i='row')} * {_LAPS.format(i='col')} AS w FROM t JOIN cells c ON {_LAPS.format(i='row')} > 0 AND {_LAPS.format(i='col')} > 0)
SELECT row, col, round(sum(w * value) / sum(w), 4) AS value, round(sum(w) / 2250000.0, 4) AS covered FROM o GROUP BY row, col""")
def align_average(spark, sf_dir):
    """1 km cells onto 1.5 km cells: each source cell gives to those it overlaps, weighted by shared area."""
    a = raster.align_average(fx.cells(spark, sf_dir), 1000, 1500)
    return a.select("row", "col", r4(F.col("value"), "value"), r4(F.col("weight") / 2_250_000.0, "covered"))


@query(f"""{_with('cells')}, t AS (SELECT CAST(r.range AS INTEGER) AS row, CAST(c.range AS INTEGER) AS col, 1.5 * (r.range + 0.5) - 0.5 AS y, 1.5 * (c.range + 0.5) - 0.5 AS x FROM range(0, 24) r, range(0, 32) c),
o AS (SELECT t.row, t.col, c.value, CAST((1 - abs(c.row - t.y)) * (1 - abs(c.col - t.x)) AS DOUBLE) AS w FROM t JOIN cells c ON abs(c.row - t.y) < 1 AND abs(c.col - t.x) < 1)
SELECT row, col, round(sum(w * value) / sum(w), 4) AS value FROM o GROUP BY row, col""")
def align_bilinear(spark, sf_dir):
    """Values at the centres of 1.5 km cells from the four cells around each, without those that hold none."""
    return raster.align_bilinear(fx.cells(spark, sf_dir), 1.5, 24, 32).select("row", "col", r4(F.col("value"), "value"))


_CLASS = "CAST(CASE WHEN value < 200 THEN 1 WHEN value < 250 THEN 2 ELSE 3 END AS INTEGER)"


@query(f"""{_with('cells')}, k AS (SELECT CAST(floor(row / 4) AS INTEGER) AS row, CAST(floor(col / 4) AS INTEGER) AS col, {_CLASS} AS class, value FROM cells), n AS (SELECT row, col, class, count(*) AS m FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY m DESC, class) AS i FROM n), a AS (SELECT row, col, avg(class) AS mean_class FROM k GROUP BY ALL)
SELECT row, col, class AS mode_class, m AS n_mode, round(mean_class, 4) AS mean_class, abs(mean_class - class) > 0.5 AS misled FROM r JOIN a USING (row, col) WHERE i = 1""")
def align_mode(spark, sf_dir):
    """The commonest class of each block, and whether an average of class codes would mislead."""
    k = fx.cells(spark, sf_dir).selectExpr("CAST(floor(row / 4) AS INT) AS row", "CAST(floor(col / 4) AS INT) AS col", f"{_CLASS.replace('INTEGER', 'INT')} AS class")
    n = k.groupBy("row", "col", "class").agg(F.count("*").alias("m"))
    mode = F.max_by("class", F.struct("m", -F.col("class")))
    g = n.groupBy("row", "col").agg(mode.alias("mode_class"), F.max("m").alias("n_mode"), (F.sum(F.col("class") * F.col("m")) / F.sum("m")).alias("mean_class"))
    return g.select("row", "col", "mode_class", "n_mode", r4(F.col("mean_class"), "mean_class"), (F.abs(F.col("mean_class") - F.col("mode_class")) > 0.5).alias("misled"))


@query(f"""{_with('cells', 'estates')}, {_CENTRES} SELECT c.row, c.col, max(e.estate_id) AS burned, count(*) AS n_over FROM centres c JOIN estates e ON c.x >= e.xmin AND c.x < e.xmax AND c.y >= e.ymin AND c.y < e.ymax GROUP BY ALL""")
def rasterize_estates(spark, sf_dir):
    """Polygons burned onto the grid: the greatest id wins where several cover a centre."""
    inside = F.expr("x >= xmin AND x < xmax AND y >= ymin AND y < ymax")
    m = spatial_join.join_within(centres(spark, sf_dir), layers.estates(spark, sf_dir), inside)
    return m.groupBy("row", "col").agg(F.max("estate_id").alias("burned"), F.count("*").alias("n_over"))


_SOURCE = "value < 190"


@query(f"""{_with('cells')}, {_CENTRES}, d AS (SELECT a.cell, a.row, a.col, a.value, b.cell AS source, b.value AS base, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM centres a JOIN centres b ON b.{_SOURCE}),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY d2, source) AS k FROM d)
SELECT row, col, source, round(sqrt(d2), 3) AS distance_m, value - base AS above_source FROM r WHERE k = 1""")
def distance_to_source(spark, sf_dir):
    """Distance of each cell to the nearest cell of a mask, which one that is, and the height above it."""
    c = centres(spark, sf_dir).select("cell", "row", "col", "value", "x", "y")
    d = spatial_join.nearest(c, c.where(_SOURCE).select("cell", "x", "y", "value"), "cell", "cell", 1, 4000.0)
    return d.select("row", "col", F.col("r_cell").alias("source"), F.round(F.sqrt("d2"), 3).alias("distance_m"), (F.col("value") - F.col("r_value")).alias("above_source"))


@query(f"""{_with('cells')} SELECT a.row, a.col, round(a.value - avg(b.value), 4) AS tpi, round(CAST(count(*) FILTER (b.value >= 240) AS DOUBLE) / count(*), 4) AS share_high
FROM cells a JOIN cells b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.row, a.col, a.value""")
def topographic_position(spark, sf_dir):
    """A cell against the mean of the square around it, and the share of one class there."""
    c = fx.cells(spark, sf_dir)
    f = raster.neighbours(c, 2).groupBy("row", "col").agg(F.avg("value").alias("m"), (F.count_if(F.col("value") >= 240) / F.count("*")).alias("s"))
    return f.join(c.select("row", "col", "value"), ["row", "col"]).select("row", "col", r4(F.col("value") - F.col("m"), "tpi"), r4(F.col("s"), "share_high"))


@query(f"""{_with('cells').replace('WITH', 'WITH RECURSIVE', 1)}, h AS (SELECT CAST(row AS BIGINT) * 48 + col AS node, row, col FROM cells WHERE value > 260),
e AS (SELECT a.node AS a, b.node AS b FROM h a JOIN h b ON abs(a.row - b.row) + abs(a.col - b.col) = 1), r(node, label) AS (SELECT node, node FROM h UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node),
l AS (SELECT node, min(label) AS patch FROM r GROUP BY node), i AS (SELECT l.patch, count(*) AS inner_edges FROM e JOIN l ON l.node = e.a GROUP BY 1), n AS (SELECT patch, count(*) AS n FROM l GROUP BY 1)
SELECT patch, n AS n_cells, 4 * n - coalesce(inner_edges, 0) AS n_edges, CAST((4 * n - coalesce(inner_edges, 0)) * 1000 AS DOUBLE) AS perimeter_m FROM n LEFT JOIN i USING (patch)""")
def polygonize_patches(spark, sf_dir):
    """Regions of cells as outlines: edges that two cells of a region share are inside it."""
    p = raster.patches(fx.cells(spark, sf_dir).where("value > 260"), 48)
    out = raster.outline_edges(p, "patch").groupBy("patch").agg(F.count("*").alias("n_edges"))
    n = p.groupBy("patch").agg(F.count("*").alias("n_cells")).join(out, "patch")
    return n.select("patch", "n_cells", "n_edges", (F.col("n_edges") * 1000.0).alias("perimeter_m"))


@query(f"""{_with('cells').replace('WITH', 'WITH RECURSIVE', 1)}, t AS (SELECT quantile_cont(value, 0.6) AS t FROM cells), h AS (SELECT CAST(row AS BIGINT) * 48 + col AS node, row, col, value FROM cells, t WHERE value > t),
e AS (SELECT a.node AS a, b.node AS b FROM h a JOIN h b ON abs(a.row - b.row) + abs(a.col - b.col) = 1), r(node, label) AS (SELECT node, node FROM h UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node),
l AS (SELECT node, min(label) AS patch FROM r GROUP BY node)
SELECT patch, count(*) AS n_cells, round(avg(value), 4) AS mean_value, row_number() OVER (ORDER BY count(*) DESC, patch) AS place FROM l JOIN h USING (node) GROUP BY patch HAVING count(*) >= 3 ORDER BY place LIMIT 10""")
def best_patches(spark, sf_dir):
    """The ten largest connected regions of cells above the 60 % quantile."""
    c = fx.cells(spark, sf_dir)
    limit = c.agg(F.percentile("value", F.lit(0.6)).alias("t"))
    p = raster.patches(c.join(F.broadcast(limit)).where("value > t").drop("t"), 48)
    g = p.groupBy("patch").agg(F.count("*").alias("n_cells"), r4(F.avg("value"), "mean_value")).where("n_cells >= 3")
    top = g.orderBy(F.desc("n_cells"), "patch").limit(10)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_cells"), "patch")).cast("bigint"))


@query(f"""{_with('cells')} SELECT min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1, count(*) AS n_valid, 48 * 36 - count(*) AS n_nodata, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean FROM cells""")
def raster_metadata(spark, sf_dir):
    """Extent, cells with and without data, range."""
    v, n = F.col("value"), F.count("*")
    ends = [f(c).alias(f"{c}{k}") for c in ("row", "col") for k, f in ((0, F.min), (1, F.max))]
    return fx.cells(spark, sf_dir).agg(*ends, n.alias("n_valid"), (48 * 36 - n).alias("n_nodata"), F.min(v).alias("low"), F.max(v).alias("high"), r4(F.avg(v), "mean"))


@query(f"""{_with('cells')} SELECT row - 9 AS row, col - 12 AS col, value, CAST(412000 + (col - 12) * 1000 AS DOUBLE) AS left_x, CAST(4627000 - (row - 9) * 1000 AS DOUBLE) AS top_y FROM cells WHERE row BETWEEN 9 AND 20 AND col BETWEEN 12 AND 27""")
def windowed_read(spark, sf_dir):
    """A window of the grid with rows, columns and origin of its own."""
    return raster.window(fx.cells(spark, sf_dir), 9, 12, 12, 16, float(fx.X0), float(fx.Y0 + 36_000), 1000.0)


_RULES = [("value", "value >= 200"), ("count", "n >= 8"), ("north", "row < 27"), ("even", "(row + col) % 2 = 0")]


@query(f"{_with('cells')} " + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS step, '{name}' AS rule, count(*) FILTER ({' AND '.join(t for _, t in _RULES[: i + 1])}) AS remaining, count(*) FILTER ({' AND '.join([*(t for _, t in _RULES[:i]), f'NOT ({test})'])}) AS lost FROM cells"
    for i, (name, test) in enumerate(_RULES)))
def constraint_cascade(spark, sf_dir):
    """Hard constraints in turn: cells that remain after each, and those it alone took, in one pass."""
    return raster.cascade(fx.cells(spark, sf_dir), _RULES)


@query(f"""{_with('points', 'cells')}, {_CENTRES}, k AS (SELECT c.row, c.col, sum(power(1 - ((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) / 9000000, 2)) AS k,
  sum(CASE WHEN p.weight < 0 THEN power(1 - ((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) / 9000000, 2) END) AS b
  FROM centres c JOIN points p ON p.kind <> 'SUPPLIER' AND (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) < 9000000 GROUP BY ALL)
SELECT row, col, round(k * 3 / (pi() * 9), 6) AS per_km2, CASE WHEN k >= 0.5 THEN round(greatest(-3, least(3, ln((coalesce(b, 0) + 0.01) / (k * 0.1)))), 6) END AS log_risk FROM k""")
def kernel_density(spark, sf_dir):
    """Quartic kernel of 3 km at every cell; relative risk of one kind of point, clipped, where support is enough."""
    c = centres(spark, sf_dir).select("row", "col", "x", "y")
    p = fx.points(spark, sf_dir).where("kind <> 'SUPPLIER'").select("x", "y", "weight")
    w = F.pow(1 - F.col("d2") / 9_000_000, 2)
    k = spatial_join.join_near(c, p, 3000.0).groupBy("row", "col").agg(F.sum(w).alias("k"), F.sum(F.when(F.col("r_weight") < 0, w)).alias("b")).where("k > 0")
    risk = F.log((F.coalesce("b", F.lit(0.0)) + 0.01) / (F.col("k") * 0.1))
    clipped = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), risk))
    return k.select("row", "col", F.round(F.col("k") * 3 / (F.pi() * 9), 6).alias("per_km2"), F.when(F.col("k") >= 0.5, F.round(clipped, 6)).alias("log_risk"))


@query(f"""{_with('cells')}, r AS (SELECT row, col, value, n, row_number() OVER (PARTITION BY floor(row / 9), floor(col / 12) ORDER BY value DESC, row, col) AS k FROM cells)
SELECT CAST(floor(row / 9) AS INTEGER) AS br, CAST(floor(col / 12) AS INTEGER) AS bc, CAST(k AS INTEGER) AS k, row, col, value FROM r WHERE k <= 3""")
def best_cells_of_blocks(spark, sf_dir):
    """The three greatest cells of every block, ties by place."""
    w = Window.partitionBy("br", "bc").orderBy(F.desc("value"), "row", "col")
    c = fx.cells(spark, sf_dir).selectExpr("CAST(floor(row / 9) AS INT) AS br", "CAST(floor(col / 12) AS INT) AS bc", "row", "col", "value")
    return c.withColumn("k", F.row_number().over(w)).where("k <= 3")
