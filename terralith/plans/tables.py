"""Registered queries of cleaning contracts, formats and coordinate systems."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terralith.functions import crs, geometry
from terralith.operators import cleaning, contracts
from terralith.plans.registry import Registry, r4
from terralith.sources import fixtures as fx
from terralith.sources import formats, layers
from terralith.sources.fixtures import table, with_layers

queries = Registry()
query = queries.add


def _with(*names: str) -> str:
    return "WITH " + ",\n".join((layers.SQL | fx.SQL)[n] for n in names)


# ---------------------------------------------------------------- contracts


@query("SELECT o_custkey % 5 AS g, count(*) AS n_orphans, count(DISTINCT o_custkey) AS n_keys FROM orders WHERE o_custkey % 50 = 7 OR o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def orphan_orders(spark, sf_dir):
    """Orders without a customer, once every fiftieth customer is taken away."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 50 <> 7")
    o = contracts.orphans(table(spark, sf_dir, "orders"), "o_custkey", c, "c_custkey")
    return o.groupBy((F.col("o_custkey") % 5).alias("g")).agg(F.count("*").alias("n_orphans"), F.countDistinct("o_custkey").alias("n_keys"))


@query(f"{_with('parcels')} SELECT min(parcel_id) AS parcel_id, count(*) AS copies FROM parcels GROUP BY xmin, ymin, xmax, ymax")
def distinct_parcels(spark, sf_dir):
    """Parcels of equal geometry, whichever vertex their rings start with and whichever way they turn."""
    p = layers.with_ring(layers.parcels(spark, sf_dir))
    turned = F.concat(F.slice("ring", 3, 2), F.slice("ring", 1, 2))
    mixed = F.when(F.col("parcel_id") % 3 == 0, turned).when(F.col("parcel_id") % 3 == 1, F.reverse("ring")).otherwise(F.col("ring"))
    return contracts.distinct_shapes(p.withColumn("ring", mixed), "ring", "parcel_id").select("parcel_id", "copies")


@query(f"{_with('parcels')}, r AS (SELECT a.parcel_id, b.xmin, b.ymin, b.xmax, b.ymax FROM parcels a JOIN parcels b ON b.parcel_id = a.parcel_id - a.parcel_id % 3) SELECT min(parcel_id) AS parcel_id, count(*) AS copies FROM r GROUP BY xmin, ymin, xmax, ymax")
def repeated_parcels(spark, sf_dir):
    """Parcels drawn three times, each time from another vertex or the other way around, are one."""
    p = layers.with_ring(layers.parcels(spark, sf_dir))
    shape = p.where("parcel_id % 3 = 0").select(F.col("parcel_id").alias("of"), "ring")
    each = p.select("parcel_id", (F.col("parcel_id") - F.col("parcel_id") % 3).alias("of")).join(shape, "of")
    turned = F.concat(F.slice("ring", 3, 2), F.slice("ring", 1, 2))
    mixed = F.when(F.col("parcel_id") % 3 == 0, turned).when(F.col("parcel_id") % 3 == 1, F.reverse("ring")).otherwise(F.col("ring"))
    return contracts.distinct_shapes(each.withColumn("ring", mixed), "ring", "parcel_id").select("parcel_id", "copies")


@query("SELECT 'LU' || lpad(CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS VARCHAR), 9, '0') AS id, p_partkey FROM part")
def surrogate_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return contracts.surrogate_ids(p, [F.desc("p_retailprice"), F.col("p_partkey")], "LU", 9).select("id", "p_partkey")


_STEPS = {
    "raw": "TRUE",
    "placed": "NOT (lon = 0 AND lat = 0)",
    "inside": "NOT (lon = 0 AND lat = 0) AND lon BETWEEN 13 AND 16 AND lat BETWEEN 40 AND 43",
    "valued": "NOT (lon = 0 AND lat = 0) AND lon BETWEEN 13 AND 16 AND lat BETWEEN 40 AND 43 AND value >= 1",
}


@query(f"{with_layers('incidents')}, s AS (" + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS step, '{n}' AS name, count(*) AS n_rows FROM incidents WHERE {t}" for k, (n, t) in enumerate(_STEPS.items())) + ") SELECT *, coalesce(n_rows - lag(n_rows) OVER (ORDER BY step), 0) AS change FROM s")
def cleaning_trail(spark, sf_dir):
    """Rows left after each step of a cleaning run."""
    i = fx.incidents(spark, sf_dir)
    return contracts.provenance([(name, i.where(test)) for name, test in _STEPS.items()])


_LAYERS = ("customer", "supplier", "part", "orders", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS layer, (SELECT count(*) FROM {t}) AS n_rows, CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS INTEGER) AS n_columns" for t in _LAYERS))
def layer_inventory(spark, sf_dir):
    return contracts.inventory({t: table(spark, sf_dir, t) for t in _LAYERS})


_REQUIRED = {"customer": {"c_custkey": "bigint", "c_acctbal": "double"}, "part": {"p_partkey": "bigint", "p_size": "bigint", "p_colour": "string"}}


@query("SELECT 'customer' AS layer, CAST(0 AS INTEGER) AS n_wrong, '' AS wrong, (SELECT count(*) FROM customer) AS n_rows UNION ALL SELECT 'part', 2, 'p_size: int instead of bigint; p_colour: missing instead of string', (SELECT count(*) FROM part)")
def required_columns(spark, sf_dir):
    """What layers lack of the columns and types a step asks for."""
    out = []
    for name, required in _REQUIRED.items():
        t = table(spark, sf_dir, name)
        wrong = contracts.missing_columns(t, required)
        out.append(t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("layer"), F.lit(len(wrong)).alias("n_wrong"), F.lit("; ".join(wrong)).alias("wrong"), "n_rows"))
    return cleaning.union_all(out)


_NUMBERS = ("p_partkey", "p_size", "p_retailprice")


@query("WITH d AS (SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CASE WHEN p_size BETWEEN 5 AND 45 THEN CAST(p_size AS DOUBLE) END AS p_size, p_retailprice FROM part) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 4) AS pct_missing, count(DISTINCT {c}) AS n_unique, min({c}) AS low, quantile_cont({c}, 0.5) AS median, max({c}) AS high FROM d" for c in _NUMBERS))
def quality_report(spark, sf_dir):
    """Missing (out of range counts as missing), distinct, least, middle and greatest values of number columns."""
    p = table(spark, sf_dir, "part").select("p_partkey", cleaning.null_unless(F.col("p_size"), 5, 45).alias("p_size"), "p_retailprice")
    return contracts.numeric_audit(p, list(_NUMBERS)).withColumn("pct_missing", F.round("pct_missing", 4))


@query("SELECT CAST(event_type AS VARCHAR) AS event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def json_properties(spark, sf_dir):
    """A field of a JSON column by declared type."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type", (F.col("k") % 10).alias("bucket")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- formats


@query(f"{_with('parcels')} SELECT parcel_id, (xmax - xmin) * (ymax - ymin) AS area FROM parcels")
def geojson_round_trip(spark, sf_dir):
    path = formats.scratch(spark, "geojson")
    formats.write_geojson(layers.with_ring(layers.parcels(spark, sf_dir)), "ring", ["parcel_id"], path)
    return formats.read_geojson(spark, path, {"parcel_id": "bigint"}).select("parcel_id", geometry.area(F.col("ring")).alias("area"))


@query(f"{_with('parcels')} SELECT parcel_id, round((xmin + xmax) / 2, 3) AS cx, (xmax - xmin) * (ymax - ymin) AS area FROM parcels WHERE xmin <= 420000 AND xmax >= 410000 AND ymin <= 4620000 AND ymax >= 4605000")
def geoparquet_bbox(spark, sf_dir):
    """Written sorted by cell with bounds and WKB, read with a box that the scan filters by."""
    path = formats.scratch(spark, "geoparquet")
    formats.write_geoparquet(layers.with_ring(layers.parcels(spark, sf_dir)), "ring", path, 4000.0)
    p = formats.read_geoparquet(spark, path, (410_000, 4_605_000, 420_000, 4_620_000))
    return p.select("parcel_id", F.round(geometry.centroid(F.col("ring"))["x"], 3).alias("cx"), geometry.area(F.col("ring")).alias("area"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def csv_round_trip(spark, sf_dir):
    """Dates and decimals through CSV, with declared types."""
    path = formats.scratch(spark, "csv")
    formats.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice"), path)
    back = formats.read_csv(spark, path, "o_orderkey bigint, day date, o_totalprice double")
    return back.groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT table_name AS layer, CAST(count(*) AS BIGINT) AS n_columns, CAST(count(*) FILTER (data_type = 'DOUBLE') AS BIGINT) AS n_double FROM information_schema.columns WHERE table_name IN ('customer', 'part', 'orders') GROUP BY 1")
def list_layers(spark, sf_dir):
    c = formats.catalog(spark, sf_dir, ["customer", "part", "orders"])
    return c.groupBy("layer").agg(F.count("*").alias("n_columns"), F.count_if(F.col("type") == "double").alias("n_double"))


# ---------------------------------------------------------------- coordinate systems

_LL = "(SELECT event_id, lon, lat FROM incidents WHERE lon BETWEEN 13 AND 16 AND lat BETWEEN 40 AND 43)"


def placed(spark, sf_dir):
    return fx.incidents(spark, sf_dir).where("lon BETWEEN 13 AND 16 AND lat BETWEEN 40 AND 43").select("event_id", "lon", "lat")


def _utm_sql() -> str:
    n = crs.FLATTENING / (2 - crs.FLATTENING)
    e = 2 * math.sqrt(n) / (1 + n)
    k = crs.SCALE * crs.meridian_radius()
    x = " + ".join(["eta", *[f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs.alpha(), 1)]])
    y = " + ".join(["xi", *[f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs.alpha(), 1)]])
    return f"""t AS (SELECT event_id, lon, lat, radians(lon - 15) AS d, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t FROM {_LL}),
x AS (SELECT event_id, lon, lat, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t), u AS (SELECT event_id, lon, lat, 500000 + {k!r}::DOUBLE * ({x}) AS x, {k!r}::DOUBLE * ({y}) AS y FROM x)"""


@query(f"{with_layers('incidents')}, {_utm_sql()} SELECT event_id, CAST(32633 AS INTEGER) AS epsg, round(x, 3) AS x, round(y, 3) AS y FROM u")
def utm_incidents(spark, sf_dir):
    x, y = crs.utm(F.col("lon"), F.col("lat"), 15.0)
    zone = F.when(F.col("lon") < 18, crs.utm_epsg(F.lit(15.0), F.col("lat")))
    return placed(spark, sf_dir).select("event_id", zone.alias("epsg"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"{with_layers('incidents')} SELECT event_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM {_LL}")
def utm_round_trip(spark, sf_dir):
    """To UTM and back again: the same coordinates to seven digits."""
    p = placed(spark, sf_dir)
    p = p.select("event_id", *[c.alias(n) for c, n in zip(crs.utm(F.col("lon"), F.col("lat"), 15.0), ("x", "y"), strict=True)])
    lon, lat = crs.utm_inverse(F.col("x"), F.col("y"), 15.0)
    return p.select("event_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


_E2 = crs.FLATTENING * (2 - crs.FLATTENING)
_Q = f"((1 - {_E2!r}::DOUBLE) * (sin(radians(lat)) / (1 - {_E2!r}::DOUBLE * power(sin(radians(lat)), 2)) + atanh(sqrt({_E2!r}::DOUBLE) * sin(radians(lat))) / sqrt({_E2!r}::DOUBLE)))"


@query(f"""{with_layers('incidents')}, p AS (SELECT *, radians(lat) AS f FROM {_LL}), t0 AS (SELECT *, f AS t FROM p), """ + ", ".join(f"t{k + 1} AS (SELECT * EXCLUDE (t), t - (2 * t + sin(2 * t) - pi() * sin(f)) / (2 + 2 * cos(2 * t)) AS t FROM t{k})" for k in range(8)) + f"""
SELECT event_id, round({crs.RADIUS} * radians(lon), 3) AS equal_x, round({crs.RADIUS} * {_Q} / 2, 3) AS equal_y, round(2 * sqrt(2.0::DOUBLE) / pi() * {crs.RADIUS} * radians(lon) * cos(t), 3) AS moll_x, round(sqrt(2.0::DOUBLE) * {crs.RADIUS} * sin(t), 3) AS moll_y FROM t8""")
def equal_area_incidents(spark, sf_dir):
    """Cylindrical equal area on the ellipsoid, Mollweide on the sphere (Newton's method inside the expression)."""
    lon, lat = F.col("lon"), F.col("lat")
    ex, ey = crs.equal_area(lon, lat)
    mx, my = crs.mollweide(lon, lat)
    return placed(spark, sf_dir).select("event_id", *[F.round(c, 3).alias(n) for c, n in ((ex, "equal_x"), (ey, "equal_y"), (mx, "moll_x"), (my, "moll_y"))])


@query(f"""{with_layers('incidents')}, p AS (SELECT *, sin(radians(41.5)) * sin(radians(lat)) + cos(radians(41.5)) * cos(radians(lat)) * cos(radians(lon - 14.5)) AS c FROM {_LL}),
k AS (SELECT *, CASE WHEN c >= 1 THEN 1 ELSE acos(c) / sin(acos(c)) END AS k FROM p)
SELECT event_id, round(6371008.8 * k * cos(radians(lat)) * sin(radians(lon - 14.5)), 2) AS x, round(6371008.8 * k * (cos(radians(41.5)) * sin(radians(lat)) - sin(radians(41.5)) * cos(radians(lat)) * cos(radians(lon - 14.5))), 2) AS y FROM k""")
def azimuthal_incidents(spark, sf_dir):
    """Azimuthal equidistant about the study area's centre."""
    x, y = crs.azimuthal_equidistant(F.col("lon"), F.col("lat"), 14.5, 41.5)
    return placed(spark, sf_dir).select("event_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


_B = crs.RADIUS * (1 - crs.FLATTENING)
_F1 = f"{1 - crs.FLATTENING!r}::DOUBLE"


def _vincenty_sql() -> str:
    f = f"{crs.FLATTENING!r}::DOUBLE"
    step = f"""SELECT * EXCLUDE (l), big_l + (1 - c) * {f} * sa * (sg + c * ss * (cm + c * cs * (2 * cm * cm - 1))) AS l FROM (SELECT *, {f} / 16 * ca2 * (4 + {f} * (4 - 3 * ca2)) AS c FROM (
  SELECT *, CASE WHEN ca2 = 0 THEN 0 ELSE cs - 2 * su1 * su2 / ca2 END AS cm FROM (SELECT *, 1 - sa * sa AS ca2 FROM (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE cu1 * cu2 * sin(l) / ss END AS sa FROM (
  SELECT *, sqrt(power(cu2 * sin(l), 2) + power(cu1 * su2 - su1 * cu2 * cos(l), 2)) AS ss, su1 * su2 + cu1 * cu2 * cos(l) AS cs FROM (SELECT event_id, lon, lat, big_l, su1, cu1, su2, cu2, l FROM {{from_}}))))))"""
    first = f"g0 AS (SELECT event_id, lon, lat, radians(lon - 14.5) AS big_l, radians(lon - 14.5) AS l, sin(atan({_F1} * tan(radians(41.5)))) AS su1, cos(atan({_F1} * tan(radians(41.5)))) AS cu1, sin(atan({_F1} * tan(radians(lat)))) AS su2, cos(atan({_F1} * tan(radians(lat)))) AS cu2 FROM {_LL})"
    rounds = ", ".join(f"g{k + 1} AS ({step.format(from_=f'g{k}')})" for k in range(8))
    u2 = f"(ca2 * {(crs.RADIUS**2 - _B**2) / _B**2!r}::DOUBLE)"
    a = f"(1 + {u2} / 16384 * (4096 + {u2} * (-768 + {u2} * (320 - 175 * {u2}))))"
    b = f"({u2} / 1024 * (256 + {u2} * (-128 + {u2} * (74 - 47 * {u2}))))"
    ds = f"({b} * ss * (cm + {b} / 4 * (cs * (2 * cm * cm - 1) - {b} / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3))))"
    return f"{first}, {rounds}, d AS (SELECT event_id, lon, lat, {_B!r}::DOUBLE * {a} * (sg - {ds}) AS geodesic FROM g8)"


_HAVERSINE = "2 * 6371008.8 * asin(sqrt(power(sin(radians(lat - 41.5) / 2), 2) + cos(radians(41.5)) * cos(radians(lat)) * power(sin(radians(lon - 14.5) / 2), 2)))"


@query(f"""{with_layers('incidents')}, {_vincenty_sql()}, e AS (SELECT CAST(floor(lat * 4) AS INTEGER) AS band, geodesic, {_HAVERSINE} AS sphere, sqrt(power(radians(lon - 14.5) * {crs.RADIUS}, 2) + power((ln(tan(pi() / 4 + radians(lat) / 2)) - ln(tan(pi() / 4 + radians(41.5) / 2))) * {crs.RADIUS}, 2)) AS mercator,
  sqrt(power(lon - 14.5, 2) + power(lat - 41.5, 2)) * 111320 AS degrees FROM d WHERE geodesic > 1000)
SELECT band, count(*) AS n, round(avg(geodesic), 2) AS geodesic_m, round(avg(abs(sphere / geodesic - 1)) * 100, 5) AS sphere_pct, round(avg(abs(mercator / geodesic - 1)) * 100, 4) AS mercator_pct, round(avg(abs(degrees / geodesic - 1)) * 100, 4) AS degrees_pct FROM e GROUP BY band""")
def crs_errors(spark, sf_dir):
    """Distances from the centre by the geodesic, the sphere, Web Mercator and plain degrees: mean errors in percent."""
    lon, lat = F.col("lon"), F.col("lat")
    g = crs.geodesic(F.lit(14.5), F.lit(41.5), lon, lat)
    (x, y), (x0, y0) = crs.web_mercator(lon, lat), crs.web_mercator(F.lit(14.5), F.lit(41.5))
    mercator = F.sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0))
    degrees = F.sqrt(F.pow(lon - 14.5, 2) + F.pow(lat - 41.5, 2)) * 111320
    d = placed(spark, sf_dir).select(F.floor(lat * 4).cast("int").alias("band"), g.alias("g"), crs.haversine(F.lit(14.5), F.lit(41.5), lon, lat).alias("s"), mercator.alias("m"), degrees.alias("d")).where("g > 1000")
    off = lambda c: F.avg(F.abs(F.col(c) / F.col("g") - 1)) * 100
    return d.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("g"), 2).alias("geodesic_m"), F.round(off("s"), 5).alias("sphere_pct"), r4(off("m"), "mercator_pct"), r4(off("d"), "degrees_pct"))
