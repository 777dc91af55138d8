"""Shapefiles and tiled rasters: round trips, partitions, windows, and the bytes of the formats."""

import datetime
import struct

import numpy as np
from pyspark.sql import functions as F

from terralith.functions import polygons
from terralith.sources import exchange

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
HOLE = [(2.0, 2.0), (2.0, 4.0), (4.0, 4.0), (4.0, 2.0)]
FAR = [(20.0, 0.0), (21.0, 0.0), (20.0, 1.0)]


def test_shapefiles_keep_parts_holes_and_fields(spark, tmp_path):
    schema = f"a_very_long_name long, a_very_long_other string, share double, day date, yes boolean, parts {exchange.PARTS}"
    rows = [
        (1, "é" * 200, 0.1, datetime.date(2024, 2, 29), True, [(SQUARE, [HOLE]), (FAR, [])]),
        (None, None, None, None, None, []), (-5, "", -1e300, datetime.date(1970, 1, 1), False, [(SQUARE[::-1], [])]), (9, " x", 1 / 3, None, None, None),
    ]
    path = f"file://{tmp_path}/s"
    exchange.write_shapefiles(spark.createDataFrame(rows, schema).repartition(2), path, "LOCAL_CS")
    back = exchange.read_shapefiles(spark, path)
    assert back.columns == ["a_very_lon", "a_very_l_1", "share", "day", "yes", "parts"]
    got = {r[0]: r for r in back.withColumn("area", polygons.area(F.col("parts"))).collect()}
    assert got[1]["area"] == 96.5 and [len(p["holes"]) for p in sorted(got[1]["parts"], key=lambda p: -len(p["holes"]))] == [1, 0]
    assert got[1]["a_very_l_1"] == "é" * 127 and got[1]["share"] == 0.1 and got[1]["day"] == datetime.date(2024, 2, 29) and got[1]["yes"] is True
    assert got[None]["parts"] == [] and got[None]["share"] is None and got[None]["yes"] is None
    assert got[-5]["share"] == -1e300 and got[-5]["area"] == 100.0 and got[9]["share"] == 1 / 3 and got[9]["parts"] == []


def test_shapefile_bytes_follow_the_format(spark, tmp_path):
    exchange.write_shapefiles(spark.createDataFrame([(1, [(SQUARE, [])])], f"id long, parts {exchange.PARTS}").coalesce(1), f"file://{tmp_path}/s")
    shp, shx, dbf = (next(tmp_path.glob(f"s/*.{e}")).read_bytes() for e in ("shp", "shx", "dbf"))
    assert struct.unpack(">i", shp[:4])[0] == 9994 and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and struct.unpack("<2i", shp[28:36]) == (1000, 5)
    assert struct.unpack("<4d", shp[36:68]) == (0, 0, 10, 10) and struct.unpack(">2i", shx[100:108]) == (50, (len(shp) - 108) // 2)
    assert dbf[0] == 3 and struct.unpack("<I", dbf[4:8])[0] == 1 and dbf[32:34] == b"id"
    ring = np.frombuffer(shp, "<f8", 10, 108 + 44 + 4).reshape(-1, 2)
    assert (ring[0] == ring[-1]).all() and sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) < 0


def test_ranges_of_records_are_read_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exchange, "RECORDS", 7)
    path = f"file://{tmp_path}/s"
    exchange.write_shapefiles(spark.range(30).select("id", F.lit(None).cast(exchange.PARTS).alias("parts")).coalesce(1), path)
    reader = exchange.ShapefileReader(path, exchange.read_shapefiles(spark, path).schema)
    parts = reader.partitions()
    assert [(p.start, p.stop) for p in parts] == [(0, 7), (7, 14), (14, 21), (21, 28), (28, 30)]
    assert [r[0] for p in parts for r in reader.read(p)] == list(range(30))


def test_names_are_told_apart():
    assert exchange.safe_names(["abcdefghijk", "abcdefghijl", "abcdefghijm", "x"]) == ["abcdefghij", "abcdefgh_1", "abcdefgh_2", "x"]


def test_rasters_by_tile_band_and_window(spark, tmp_path):
    cells = spark.range(700 * 300).selectExpr("CAST(id div 300 AS INT) AS row", "CAST(id % 300 AS INT) AS col", "CAST(id AS DOUBLE) AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE id * 0.5 END AS b")
    path = f"file://{tmp_path}/r"
    exchange.write_rasters(cells, ["a", "b"], path, 1000.0, 9000.0, 10.0)
    assert len(list(tmp_path.glob("r/*.tif"))) == 6
    back = exchange.read_rasters(spark, path, 1000.0, 9000.0, 10.0)
    assert {tuple(r) for r in back.groupBy("band", "description").count().collect()} == {(0, "a", 210000), (1, "b", 140000)}
    wrong = back.where("band = 0").join(cells, ["row", "col"]).where("value <> a").count()
    assert wrong == 0
    w = exchange.read_rasters(spark, path, 1000.0, 9000.0, 10.0, [1], (255, 258, 254, 258)).collect()
    assert {(r["row"], r["col"]) for r in w} == {(i, j) for i in (255, 256, 257) for j in range(254, 258) if (i * 300 + j) % 3} and all(r["value"] == (r["row"] * 300 + r["col"]) * 0.5 for r in w)
    reader = exchange.RasterReader({"path": path, "left": "1000", "top": "9000", "size": "10", "bands": "1", "row0": "0", "row1": "10", "col0": "0", "col1": "10"})
    assert sum(len(p.tiles) for p in reader.partitions()) == 1


def test_empty_layers(spark, tmp_path):
    exchange.write_shapefiles(spark.createDataFrame([], f"id long, parts {exchange.PARTS}"), f"file://{tmp_path}/none")
    assert exchange.read_shapefiles(spark, f"file://{tmp_path}/none").count() == 0
    exchange.write_rasters(spark.createDataFrame([], "row int, col int, a double"), ["a"], f"file://{tmp_path}/empty", 0.0, 0.0, 1.0)
    assert exchange.read_rasters(spark, f"file://{tmp_path}/empty", 0.0, 0.0, 1.0).count() == 0
