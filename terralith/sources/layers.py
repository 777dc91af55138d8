"""Polygon and line layers that grow with the plain tables, by integer rules that any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import geometry
from terralith.sources.fixtures import table

_K = "CAST({k} AS BIGINT)"
#: Boxes on a grid of 100 m, so that some touch, some are equal and some lie within another.
PARCEL = {
    "xmin": "CAST(400000 + (k * 7919 % 480) * 100 AS DOUBLE)",
    "ymin": "CAST(4600000 + ((k * 104729 + CAST(floor(k / 1440) AS BIGINT) * 37) % 360) * 100 AS DOUBLE)",
    "xmax": "CAST(400000 + (k * 7919 % 480) * 100 + 200 + (k % 5) * 100 AS DOUBLE)",
    "ymax": "CAST(4600000 + ((k * 104729 + CAST(floor(k / 1440) AS BIGINT) * 37) % 360) * 100 + 200 + (k % 3) * 100 AS DOUBLE)",
}
#: Larger boxes, one a supplier.
ESTATE = {
    "xmin": "CAST(400000 + (k * 7919 % 460) * 100 AS DOUBLE)",
    "ymin": "CAST(4600000 + (k * 10473 % 340) * 100 AS DOUBLE)",
    "xmax": "CAST(400000 + (k * 7919 % 460) * 100 + 1500 AS DOUBLE)",
    "ymax": "CAST(4600000 + (k * 10473 % 340) * 100 + 1000 AS DOUBLE)",
}
#: Straight roads, one a supplier, every fourth one level.
ROAD = {
    "ax": "CAST(400000 + (k * 7919 % 440) * 100 AS DOUBLE)",
    "ay": "CAST(4600050 + (k * 10473 % 330) * 100 AS DOUBLE)",
    "bx": "CAST(400000 + (k * 7919 % 440) * 100 + 4000 AS DOUBLE)",
    "b_y": "CAST(4600050 + (k * 10473 % 330) * 100 + (k % 4) * 1000 AS DOUBLE)",
}


def _from(spark: SparkSession, sf_dir: str, name: str, key: str, rules: dict[str, str], as_: str) -> DataFrame:
    keyed = table(spark, sf_dir, name).selectExpr(f"CAST({key} AS BIGINT) AS k")
    return keyed.selectExpr(f"k AS {as_}", *[f"{e} AS {c}" for c, e in rules.items()])


def with_ring(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("ring", geometry.box(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "part", "p_partkey", PARCEL, "parcel_id")


def estates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "supplier", "s_suppkey", ESTATE, "estate_id")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _from(spark, sf_dir, "supplier", "s_suppkey", ROAD, "road_id")
    line = F.struct("ax", "ay", "bx", F.col("b_y").alias("by")).alias("line")
    box = [f(a, b).alias(c) for f, a, b, c in ((F.least, "ax", "bx", "xmin"), (F.least, "ay", "b_y", "ymin"), (F.greatest, "ax", "bx", "xmax"), (F.greatest, "ay", "b_y", "ymax"))]
    return r.select("road_id", line, *box)


#: What is cut out of a box, by remainder of its key: column, row and size of a box, in metres from its corners.
NOTCHES = {
    "plots": (4, {0: ("xmax - 100", "ymax - 100", "xmax", "ymax"), 1: ("xmin + 50", "ymin + 50", "xmin + 150", "ymin + 150"), 2: ("xmin + 50", "ymin + 100", "xmin + 100", "ymax")}),
    "yards": (3, {0: ("xmin + 500", "ymin + 300", "xmin + 1000", "ymin + 700"), 1: ("xmin", "ymax - 500", "xmin + 700", "ymax")}),
}


def _shape(name: str, key: str) -> str:
    """SQL of parts: an L or a U where the cut box reaches the border, a hole where it lies within."""
    ring = lambda *v: "array(" + ", ".join(f"named_struct('x', double({x}), 'y', double({y}))" for x, y in v) + ")"
    none = "CAST(array() AS array<array<struct<x:double,y:double>>>)"
    part = lambda shell, holes=none: f"array(named_struct('shell', {shell}, 'holes', {holes}))"
    box = ring(("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))
    n, cuts = NOTCHES[name]
    out = []
    for k, (x0, y0, x1, y1) in cuts.items():
        if y1 != "ymax":
            shape = part(box, f"array({ring((x0, y0), (x0, y1), (x1, y1), (x1, y0))})")
        elif x1 == "xmax":
            shape = part(ring(("xmin", "ymin"), ("xmax", "ymin"), ("xmax", y0), (x0, y0), (x0, "ymax"), ("xmin", "ymax")))
        elif x0 == "xmin":
            shape = part(ring(("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), (x1, "ymax"), (x1, y0), ("xmin", y0)))
        else:
            shape = part(ring(("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), (x1, "ymax"), (x1, y0), (x0, y0), (x0, "ymax"), ("xmin", "ymax")))
        out.append(f"WHEN {key} % {n} = {k} THEN {shape}")
    return f"CASE {' '.join(out)} ELSE {part(box)} END"


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with notches, slots or holes: plot_id, bounds, parts."""
    p = parcels(spark, sf_dir).withColumnRenamed("parcel_id", "plot_id")
    return p.withColumn("parts", F.expr(_shape("plots", "plot_id")))


def yards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estates with notches or holes: yard_id, bounds, parts."""
    e = estates(spark, sf_dir).withColumnRenamed("estate_id", "yard_id")
    return e.withColumn("parts", F.expr(_shape("yards", "yard_id")))


#: Side of the square cells of which plots and yards are made.
UNIT = 50


def _sql_cells(name: str, table_: str, key: str, rules: dict[str, str], as_: str) -> str:
    """SQL of the unit cells (column i, row j) of every shape."""
    n, cuts = NOTCHES[name]
    x, y = f"{UNIT} * i + 1", f"{UNIT} * j + 1"
    cut = " OR ".join(f"(k % {n} = {r} AND {x} > {x0} AND {x} < {x1} AND {y} > {y0} AND {y} < {y1})" for r, (x0, y0, x1, y1) in cuts.items())
    cols = ", ".join(f"CAST({e} AS BIGINT) AS {c}" for c, e in rules.items())
    return f"""{name}_cells AS MATERIALIZED (SELECT k AS {as_}, i, j FROM (SELECT k, {cols} FROM (SELECT CAST({key} AS BIGINT) AS k FROM {table_})) s,
  unnest(range(xmin // {UNIT}, xmax // {UNIT})) AS u(i), unnest(range(ymin // {UNIT}, ymax // {UNIT})) AS v(j) WHERE NOT ({cut}))"""


def _sql(name: str, table_: str, key: str, rules: dict[str, str], as_: str) -> str:
    cols = ", ".join(f"{e} AS {c}" for c, e in rules.items())
    return f"{name} AS (SELECT k AS {as_}, {cols} FROM (SELECT CAST({key} AS BIGINT) AS k FROM {table_}))"


#: The same layers as common table expressions.
SQL = {
    "parcels": _sql("parcels", "part", "p_partkey", PARCEL, "parcel_id"),
    "estates": _sql("estates", "supplier", "s_suppkey", ESTATE, "estate_id"),
    "plots_cells": _sql_cells("plots", "part", "p_partkey", PARCEL, "plot_id"),
    "yards_cells": _sql_cells("yards", "supplier", "s_suppkey", ESTATE, "yard_id"),
    "roads": _sql("roads", "supplier", "s_suppkey", ROAD, "road_id"),
}
