"""Registered queries through exchange files: shapefiles, tiled rasters, standard GeoJSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.functions import crs, polygons
from terralith.plans.registry import Registry
from terralith.sources import exchange, formats, layers
from terralith.sources import fixtures as fx

queries = Registry()
query = queries.add


def _with(*names: str) -> str:
    return "WITH " + ",\n".join((layers.SQL | fx.SQL)[n] for n in names)


@query(f"""{_with('plots_cells')}, c AS (SELECT plot_id, CAST(count(*) * {layers.UNIT**2} AS DOUBLE) AS area FROM plots_cells GROUP BY plot_id)
SELECT plot_id AS plot_ident, 'plot ' || plot_id AS plot_ide_1, plot_id / 7.0::DOUBLE AS share, DATE '2024-01-01' + CAST(plot_id % 300 AS INTEGER) AS surveyed, plot_id % 3 = 0 AS open, area, CAST(CASE WHEN plot_id % 4 = 1 THEN 1 ELSE 0 END AS INTEGER) AS n_holes FROM c""")
def shapefile_round_trip(spark, sf_dir):
    """Notched and holed plots through shapefiles: names cut to ten letters, dates, flags, numbers, holes."""
    path = formats.scratch(spark, "shapefile")
    p = layers.plots(spark, sf_dir).selectExpr("plot_id AS plot_identifier", "concat('plot ', plot_id) AS plot_identity", "plot_id / 7.0D AS share", "date_add(DATE '2024-01-01', CAST(plot_id % 300 AS INT)) AS surveyed", "plot_id % 3 = 0 AS open", "parts")
    exchange.write_shapefiles(formats.in_files(p), path)
    back = exchange.read_shapefiles(spark, path)
    holes = F.aggregate("parts", F.lit(0), lambda n, s: n + F.size(s["holes"]))
    return back.select("plot_ident", "plot_ide_1", "share", "surveyed", "open", F.round(polygons.area(F.col("parts")), 3).alias("area"), holes.alias("n_holes"))


@query(f"{_with('cells')} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, value, CAST(n AS DOUBLE) AS n FROM cells")
def multiband_raster(spark, sf_dir):
    """Two bands written as tiles with descriptions, read band by band and put side by side."""
    path = formats.scratch(spark, "raster")
    exchange.write_rasters(fx.cells(spark, sf_dir), ["value", "n"], path, fx.X0, fx.Y0 + fx.HEIGHT, 1000.0)
    back = exchange.read_rasters(spark, path, fx.X0, fx.Y0 + fx.HEIGHT, 1000.0)
    return back.groupBy("row", "col").pivot("description", ["value", "n"]).agg(F.first("value"))


@query(f"{_with('cells')} SELECT count(*) AS n_cells, round(avg(n), 6) AS mean, max(n)::DOUBLE AS most FROM cells WHERE row >= 10 AND row < 20 AND col >= 5 AND col < 30")
def raster_window(spark, sf_dir):
    """A window of one band: only tiles that it meets are read."""
    path = formats.scratch(spark, "raster")
    exchange.write_rasters(fx.cells(spark, sf_dir), ["value", "n"], path, fx.X0, fx.Y0 + fx.HEIGHT, 1000.0)
    w = exchange.read_rasters(spark, path, fx.X0, fx.Y0 + fx.HEIGHT, 1000.0, [1], (10, 20, 5, 30))
    return w.agg(F.count("*").alias("n_cells"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))


@query(f"""{_with('plots_cells')} SELECT plot_id, CASE WHEN plot_id % 5 = 0 THEN NULL ELSE 'n' || plot_id END AS name, CAST(count(*) * {layers.UNIT**2} AS DOUBLE) AS area, CAST(CASE WHEN plot_id % 4 = 1 THEN 1 ELSE 0 END AS INTEGER) AS n_holes FROM plots_cells GROUP BY plot_id""")
def geojson_degrees(spark, sf_dir):
    """Plots through standard GeoJSON in degrees, and back into metres."""
    path = formats.scratch(spark, "collections")
    p = layers.plots(spark, sf_dir).selectExpr("plot_id", "CASE WHEN plot_id % 5 <> 0 THEN concat('n', plot_id) END AS name", "parts")
    formats.write_feature_collections(p, "parts", ["plot_id", "name"], path, 15.0)
    back = formats.read_feature_collections(spark, path, "plot_id:bigint,name:string")
    metres = lambda r: F.transform(r, lambda q: _metres(q))
    parts = F.transform("parts", lambda s: F.struct(metres(s["shell"]).alias("shell"), F.transform(s["holes"], metres).alias("holes")))
    holes = F.aggregate("parts", F.lit(0), lambda n, s: n + F.size(s["holes"]))
    return back.select("plot_id", "name", F.round(polygons.area(parts), 0).alias("area"), holes.alias("n_holes"))


def _metres(q):
    x, y = crs.utm(q["x"], q["y"], 15.0)
    return F.struct(x.alias("x"), y.alias("y"))
