"""Spatial layers derived from the plain tables: the same integer rules give the same rows in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Envelope of the study area in metres (UTM zone 33 N), and its 6 x 4 districts of 8 km by 9 km.
X0, Y0, WIDTH, HEIGHT = 400_000, 4_600_000, 48_000, 36_000
DISTRICT_X, DISTRICT_Y, COLUMNS = 8_000, 9_000, 6
#: Cell of an order by two independent parts of its key, and the cells that hold data.
CELL_COL, CELL_ROW = "CAST(o_orderkey % 48 AS INT)", "CAST(floor(o_orderkey / 48) % 36 AS INT)"
NO_DATA = "(row * 7 + col * 3) % 29 <> 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def x_of(key: str) -> str:
    return f"({X0} + (CAST({key} AS BIGINT) * 7919) % {WIDTH} + 0.5)"


def y_of(key: str) -> str:
    return f"({Y0} + (CAST({key} AS BIGINT) * 104729) % {HEIGHT} + 0.5)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, kind, x, y, weight of customers (by market segment) and suppliers."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS pid", "c_mktsegment AS kind", f"CAST({x_of('c_custkey')} AS DOUBLE) AS x", f"CAST({y_of('c_custkey')} AS DOUBLE) AS y", "c_acctbal AS weight")
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS pid", "'SUPPLIER' AS kind", f"CAST({x_of('s_suppkey')} AS DOUBLE) AS x", f"CAST({y_of('s_suppkey')} AS DOUBLE) AS y", "s_acctbal AS weight")
    return c.unionByName(s)


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The districts that nations 0 to 23 stand for: id and bounds."""
    n = table(spark, sf_dir, "nation").where("n_nationkey < 24")
    return n.selectExpr("n_nationkey AS district_id", "n_name AS name", *bounds("n_nationkey"))


def bounds(key: str) -> list[str]:
    col, row = f"({key} % {COLUMNS})", f"CAST(floor({key} / {COLUMNS}) AS INT)"
    return [f"CAST({X0} + {DISTRICT_X} * {col} AS DOUBLE) AS xmin", f"CAST({Y0} + {DISTRICT_Y} * {row} AS DOUBLE) AS ymin", f"CAST({X0} + {DISTRICT_X} * ({col} + 1) AS DOUBLE) AS xmax", f"CAST({Y0} + {DISTRICT_Y} * ({row} + 1) AS DOUBLE) AS ymax"]


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octagons (boxes with cut corners), one a nation: zone_id, bounds and an open ring of vertices."""
    d = districts(spark, sf_dir).selectExpr("district_id AS zone_id", "xmin + 500 AS xmin", "ymin + 500 AS ymin", "xmax - 1500 AS xmax", "ymax - 500 AS ymax")
    corner = [("xmin+2000", "ymin"), ("xmax-2000", "ymin"), ("xmax", "ymin+2000"), ("xmax", "ymax-2000"), ("xmax-2000", "ymax"), ("xmin+2000", "ymax"), ("xmin", "ymax-2000"), ("xmin", "ymin+2000")]
    ring = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in corner)
    return d.withColumn("ring", F.expr(f"array({ring})"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 48 x 36 raster of 1 km cells: row, col, value (mean order price in whole thousands), n.

    Cells without data (every 29th, in a slanted pattern) have no row.
    """
    o = table(spark, sf_dir, "orders").selectExpr(f"{CELL_COL} AS col", f"{CELL_ROW} AS row", "CAST(round(o_totalprice) AS BIGINT) AS price").where(NO_DATA)
    return o.groupBy("row", "col").agg(F.round(F.sum("price") / F.count("*") / 1000).alias("value"), F.count("*").alias("n"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as incidents with dirty coordinates: some swapped, some at (0, 0), some outside."""
    lon, lat = "14.0 + (event_id * 37 % 1000) / 1000.0", "41.0 + (event_id * 53 % 1000) / 1000.0"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type", "ts", "value",
        f"CAST(CASE WHEN event_id % 101 = 0 THEN 0 WHEN event_id % 97 = 0 THEN {lat} WHEN event_id % 89 = 0 THEN 99 ELSE {lon} END AS DOUBLE) AS lon",
        f"CAST(CASE WHEN event_id % 101 = 0 THEN 0 WHEN event_id % 97 = 0 THEN {lon} ELSE {lat} END AS DOUBLE) AS lat",
    )


_SQL_POINTS = f"""points AS (
  SELECT c_custkey AS pid, c_mktsegment AS kind, CAST({x_of('c_custkey')} AS DOUBLE) AS x, CAST({y_of('c_custkey')} AS DOUBLE) AS y, c_acctbal AS weight FROM customer
  UNION ALL SELECT s_suppkey, 'SUPPLIER', CAST({x_of('s_suppkey')} AS DOUBLE), CAST({y_of('s_suppkey')} AS DOUBLE), s_acctbal FROM supplier)"""
_SQL_DISTRICTS = f"districts AS (SELECT n_nationkey AS district_id, n_name AS name, {', '.join(bounds('n_nationkey'))} FROM nation WHERE n_nationkey < 24)"
_SQL_CELLS = f"""cells AS (SELECT row, col, round(CAST(sum(price) AS BIGINT) / count(*) / 1000) AS value, count(*) AS n
  FROM (SELECT {CELL_COL} AS col, {CELL_ROW} AS row, CAST(round(o_totalprice) AS BIGINT) AS price FROM orders) WHERE {NO_DATA} GROUP BY row, col)"""
_SQL_INCIDENTS = """incidents AS (SELECT event_id, event_type, ts, value,
  CAST(CASE WHEN event_id % 101 = 0 THEN 0 WHEN event_id % 97 = 0 THEN 41.0 + (event_id * 53 % 1000) / 1000.0 WHEN event_id % 89 = 0 THEN 99 ELSE 14.0 + (event_id * 37 % 1000) / 1000.0 END AS DOUBLE) AS lon,
  CAST(CASE WHEN event_id % 101 = 0 THEN 0 WHEN event_id % 97 = 0 THEN 14.0 + (event_id * 37 % 1000) / 1000.0 ELSE 41.0 + (event_id * 53 % 1000) / 1000.0 END AS DOUBLE) AS lat FROM events)"""
#: The same layers as common table expressions.
SQL = {"points": _SQL_POINTS, "districts": _SQL_DISTRICTS, "cells": _SQL_CELLS, "incidents": _SQL_INCIDENTS}


def with_layers(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
