"""Readers and writers of layers: GeoJSON, CSV with dates, Parquet with WKB, catalogs of layers.

Files go to and come from folders that Spark can reach; a layer is written by many tasks and read the same way.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import crs, geometry
from terralith.functions.polygons import bounds


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return f"{named.rstrip('/')}/terralith/{name}-{uuid.uuid4().hex}"


def in_files(layer: DataFrame, rows: int = 20_000) -> DataFrame:
    """layer dealt over so many tasks, each of which writes a file, that a file holds about so many rows."""
    return layer.repartition(max(1, -(-layer.count() // rows)))


# ---------------------------------------------------------------- GeoJSON, one feature a line

_FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:array<array<array<double>>>>"


def write_geojson(layer: DataFrame, ring: str, properties: list[str], path: str) -> None:
    """Features with closed polygon rings, one a line, in as many files as there are tasks."""
    point = lambda p: F.array(p["x"], p["y"])
    closed = F.transform(F.concat(F.col(ring), F.slice(ring, 1, 1)), point)
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    names = F.create_map(*[x for c in properties for x in (F.lit(c), F.col(c).cast("string"))])
    layer.select(F.lit("Feature").alias("type"), names.alias("properties"), geometry.alias("geometry")).write.json(path)


def read_geojson(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """Properties by declared type (never inferred) and the open outer ring."""
    f = spark.read.schema(_FEATURE).json(path)
    outer = F.col("geometry.coordinates")[0]
    ring = F.transform(F.slice(outer, 1, F.size(outer) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select(*[F.col("properties")[c].cast(t).alias(c) for c, t in properties.items()], ring.alias("ring"))


# ---------------------------------------------------------------- GeoJSON in degrees, FeatureCollections


def _in_degrees(ring: Column, central: float) -> Column:
    """A closed ring of [longitude, latitude] of vertices in metres of a UTM zone."""
    point = lambda lon, lat: F.array(F.round(lon, 12), F.round(lat, 12))
    return F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: point(*crs.utm_inverse(p["x"], p["y"], central)))


def write_feature_collections(layer: DataFrame, parts: str, properties: list[str], path: str, central: float) -> None:
    """Standard GeoJSON: longitudes and latitudes, shells counterclockwise and holes clockwise, each task's file a FeatureCollection
    of its own, of in_files' size as a file is read by one task. A polygon without parts has a null geometry."""
    turned = lambda r, left: F.when((geometry.signed_area(r) > 0) == F.lit(left), r).otherwise(F.reverse(r))
    rings = lambda s: F.concat(F.array(turned(s["shell"], True)), F.transform(s["holes"], lambda h: turned(h, False)))
    polygons_ = F.transform(parts, lambda s: F.transform(rings(s), lambda r: _in_degrees(r, central)))
    shape = F.when(F.size(parts) == 1, F.to_json(F.struct(F.lit("Polygon").alias("type"), polygons_[0].alias("coordinates")))).when(F.size(parts) > 1, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), polygons_.alias("coordinates"))))
    names = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    lines = in_files(layer).select(F.concat(F.lit('{"type":"Feature","properties":'), names, F.lit(',"geometry":'), F.coalesce(shape, F.lit("null")), F.lit("}")).alias("value"))

    def wrap(batches):
        import pyarrow as pa

        begun = False
        for batch in batches:
            values = [("," if begun or k else '{"type":"FeatureCollection","features":[\n') + v for k, v in enumerate(batch.column(0).to_pylist())]
            begun = begun or bool(values)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array(["]}"])], ["value"])

    lines.mapInArrow(wrap, "value string").write.text(path)


def read_feature_collections(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Properties as declared and parts in degrees of all FeatureCollections of a folder. The format has no places to split
    at, so a file is read by one task; a layer is to be many files."""
    ring = "array<array<array<double>>>"
    f = spark.read.schema(f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>").option("multiLine", True).json(path)
    f = f.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry").alias("g"))
    many = F.from_json("g.coordinates", f"array<{ring}>")
    shapes = F.when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", ring))).when(F.col("g.type") == "MultiPolygon", many)
    opened = lambda r: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    part = lambda rings: F.struct(opened(rings[0]).alias("shell"), F.transform(F.slice(rings, F.lit(2), F.size(rings)), opened).alias("holes"))
    return f.withColumn("parts", F.coalesce(F.transform(shapes, part), F.array().cast("array<struct<shell:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>>"))).drop("g")


# ---------------------------------------------------------------- WKB


def to_wkb(ring: Column) -> Column:
    """Little-endian WKB of a polygon with one ring: a small helper over whole Arrow batches."""
    @F.pandas_udf("binary")
    def encode(rings: pd.Series) -> pd.Series:
        def one(r):
            xy = np.array([(p["x"], p["y"]) for p in r] + [(r[0]["x"], r[0]["y"])], "<f8")
            return b"\x01\x03\x00\x00\x00\x01\x00\x00\x00" + np.uint32(len(xy)).astype("<u4").tobytes() + xy.tobytes()

        return rings.map(lambda r: None if r is None or not len(r) else one(r))

    return encode(F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))


def from_wkb(wkb: Column) -> Column:
    """The open ring of such a WKB."""
    @F.pandas_udf("array<struct<x:double,y:double>>")
    def decode(values: pd.Series) -> pd.Series:
        def one(b):
            xy = np.frombuffer(b, "<f8", offset=13).reshape(-1, 2)[:-1]
            return [{"x": float(x), "y": float(y)} for x, y in xy]

        return values.map(lambda b: None if b is None else one(b))

    return decode(wkb)


def write_geoparquet(layer: DataFrame, ring: str, path: str, cell: float) -> None:
    """Parquet with a WKB column and each row's bounds, sorted by grid cell so that a filter on bounds skips row groups."""
    own = [c for c in layer.columns if c not in (ring, "xmin", "ymin", "xmax", "ymax")]
    out = layer.select(*own, bounds(F.col(ring)).alias("__b"), to_wkb(F.col(ring)).alias("geometry")).select(*own, "__b.*", "geometry")
    keys = [F.floor(F.col("xmin") / cell), F.floor(F.col("ymin") / cell)]
    out.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def read_geoparquet(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The layer, or the features whose bounds meet a box: the comparison reaches the Parquet scan."""
    layer = spark.read.parquet(path)
    if box:
        x0, y0, x1, y1 = (F.lit(float(v)) for v in box)
        layer = layer.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
    return layer.withColumn("ring", from_wkb(F.col("geometry")))


# ---------------------------------------------------------------- CSV


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Declared types; a row that can't be read as declared stops the job."""
    return spark.read.schema(schema).option("header", True).option("dateFormat", date_format).option("mode", "FAILFAST").csv(path)


# ---------------------------------------------------------------- catalogs


def catalog(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """layer, column, type of every column, in the layers' order: read from footers, no row is scanned."""
    rows = [(name, k, c, t) for name in names for k, (c, t) in enumerate(spark.read.parquet(f"{sf_dir}/{name}.parquet").dtypes)]
    return spark.createDataFrame(rows, "layer string, position int, column string, type string")
