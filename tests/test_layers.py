"""Edges that the registered queries don't reach: boundaries, empty tables, nulls, pushed filters, goldens."""

import math

import pytest
from pyspark.sql import functions as F

from terralith import catalog
from terralith.functions import crs, geometry, polygons
from terralith.operators import cleaning, contracts, spatial_join, statistics
from terralith.plans import inference
from terralith.sources import formats, layers

SF = "/root/testdata/sf0.01"


def ring(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])


SQUARE = ((0, 0), (10, 0), (10, 10), (0, 10))


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("x", "y", "place"), [(5, 5, "I"), (0, 5, "B"), (10, 10, "B"), (10, 3, "B"), (11, 5, "E"), (-1, 0, "E"), (5, 0, "B")])
def test_points_on_a_boundary(spark, x, y, place):
    assert one(spark, p=polygons.locate(ring(*SQUARE), F.lit(float(x)), F.lit(float(y))))["p"] == place


def test_relations_of_two_squares(spark):
    cases = {"touches": ((10, 0), (20, 0), (20, 10), (10, 10)), "within": ((-5, -5), (15, -5), (15, 15), (-5, 15)), "overlaps": ((5, 5), (15, 5), (15, 15), (5, 15)), "disjoint": ((20, 20), (30, 20), (30, 30), (20, 30)), "equals": SQUARE}
    for name, other in cases.items():
        r = polygons.relation(ring(*SQUARE), ring(*other))
        got = one(spark, **r)
        assert got[name], name
        assert got["intersects"] != got["disjoint"] and not (got["touches"] and got["overlaps"])
    corner = one(spark, d=polygons.distance(ring(*SQUARE), ring((13, 14), (20, 14), (20, 20), (13, 20))))
    assert corner["d"] == 5.0


def test_crossing_touching_and_inner_segments(spark):
    line = lambda *v: F.struct(*[F.lit(float(c)).alias(n) for n, c in zip(("ax", "ay", "bx", "by"), v, strict=True)])
    for v, want in (((-5, 5, 15, 5), True), ((2, 2, 8, 8), False), ((-5, 0, 15, 0), False), ((5, 5, 5, 30), True), ((20, 0, 30, 5), False)):
        assert one(spark, c=polygons.crosses(line(*v), ring(*SQUARE)))["c"] == want, v


def test_raster_queries_reach_neighbours(spark):
    q = catalog.queries()
    assert q["focal_mean"](spark, SF).where("n_cells > 1").count() > 1000
    assert q["terrain_slope"](spark, SF).count() > 1000 and q["candidate_patches"](spark, SF).count() > 0
    assert q["dissolve_districts"](spark, SF).agg(F.max("n_edges")).first()[0] < 32
    assert q["within_distance"](spark, SF).where("nearest_m > 0").count() > 50


def test_pairs_meet_once_and_plans_hold_no_cross_join(spark):
    p = layers.with_ring(layers.parcels(spark, SF))
    m = spatial_join.pairs(p, p, 300.0)
    assert m.count() == m.select("parcel_id", "r_parcel_id").distinct().count() == spatial_join.pairs(p, p, 5000.0).count()
    assert "NestedLoop" not in m._jdf.queryExecution().executedPlan().toString()
    assert spatial_join.pairs(p.where("false"), p).count() == 0


def test_ranks_with_ties_nulls_and_one_value(spark):
    d = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (3, "a", 1.0), (4, "a", None), (5, "b", 7.0)], "k int, g string, v double")
    got = {r["k"]: (r["rank"], r["n"]) for r in statistics.ranked(d, "g", "v").collect()}
    assert got == {1: (2.5, 3), 2: (2.5, 3), 3: (1.0, 3), 4: (None, None), 5: (1.0, 1)}
    assert statistics.ranked(d.where("false"), "g", "v").count() == 0


def test_contracts_on_empty_and_null_keys(spark):
    d = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "k int, parent int")
    assert [r["k"] for r in contracts.orphans(d, "parent", d.where("k = 1"), "parent").collect()] == [3]
    assert contracts.orphans(d.where("false"), "parent", d, "parent").count() == 0
    rows = spark.range(1000).withColumnRenamed("id", "v").repartition(7)
    ids = sorted((r["id"], r["v"]) for r in contracts.surrogate_ids(rows, [F.desc("v")], "X", 4).collect())
    assert ids == [(f"X{k + 1:04d}", 999 - k) for k in range(1000)]
    audit = {r["column"]: (r["n_missing"], r["n_unique"]) for r in cleaning.audit(d).collect()}
    assert audit == {"k": (0, 3), "parent": (1, 2)}
    assert contracts.missing_columns(d, {"k": "int", "parent": "bigint", "z": "string"}) == ["parent: int instead of bigint", "z: missing instead of string"]


def test_bounds_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/parcels"
    formats.write_geoparquet(layers.with_ring(layers.parcels(spark, SF)), "ring", path, 4000.0)
    plan = formats.read_geoparquet(spark, path, (410_000, 4_605_000, 420_000, 4_620_000))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(xmin" in plan
    back = formats.read_geoparquet(spark, path).select(F.sum(geometry.area(F.col("ring")))).first()[0]
    assert back == layers.with_ring(layers.parcels(spark, SF)).select(F.sum(geometry.area(F.col("ring")))).first()[0]


def test_projections_at_known_places(spark):
    # a degree of the meridian at the equator, and a quarter of it, on WGS 84
    r = one(spark, a=crs.geodesic(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), b=crs.geodesic(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), c=crs.geodesic(F.lit(3.0), F.lit(4.0), F.lit(3.0), F.lit(4.0)))
    assert math.isclose(r["a"], 110574.389, abs_tol=0.01) and math.isclose(r["b"], 111319.491, abs_tol=0.01) and r["c"] == 0.0
    x, y = crs.mollweide(F.lit(180.0), F.lit(0.0))
    p, q = crs.mollweide(F.lit(0.0), F.lit(90.0))
    r = one(spark, x=x, y=y, p=p, q=q)
    assert math.isclose(r["x"], 2 * math.sqrt(2) * crs.RADIUS, rel_tol=1e-9) and abs(r["y"]) < 1e-6 and math.isclose(r["q"], math.sqrt(2) * crs.RADIUS, rel_tol=1e-4)
    x, y = crs.azimuthal_equidistant(F.lit(14.5), F.lit(41.5), 14.5, 41.5)
    r = one(spark, x=x, y=y)
    assert abs(r["x"]) < 1e-6 and abs(r["y"]) < 1e-6


def test_permutations_are_the_same_in_every_run(spark):
    v = inference.counts(spark, SF)
    from terralith.operators.inference import shuffled

    a, b = (sorted(map(tuple, shuffled(v.repartition(n), 5).select("round", "zone_id", "value").collect())) for n in (1, 4))
    assert a == b and len(a) == 5 * 24
    assert sorted(x[2] for x in a if x[0] == 1) == sorted(r["value"] for r in v.collect())


def test_points_on_cut_corners_are_outside_octagons(spark):
    from terralith.plans.spatial import in_octagon

    box = {"xmin": 0.0, "ymin": 0.0, "xmax": 6000.0, "ymax": 8000.0}
    corners = [(2000.0, 0.0), (4000.0, 0.0), (6000.0, 2000.0), (6000.0, 6000.0), (4000.0, 8000.0), (2000.0, 8000.0), (0.0, 6000.0), (0.0, 2000.0)]
    zone = spark.createDataFrame([(7, *box.values())], "zone_id int, xmin double, ymin double, xmax double, ymax double").withColumn("ring", ring(*corners))
    cuts = [(500.5, 1499.5), (5000.5, 1000.5), (5000.5, 6999.5), (500.5, 6500.5)]  # on the four cut corners
    at = spark.createDataFrame([(k, x + d, y) for k, (x, y) in enumerate(cuts) for d in (-1.0, 0.0, 1.0)], "pid int, x double, y double")
    got = sorted((r["pid"], r["x"]) for r in spatial_join.join_within(at, zone, in_octagon()).collect())
    assert got == [(0, 501.5), (1, 4999.5), (2, 4999.5), (3, 501.5)]


def copied(spark, duck, tmp_path):
    """Small parts and suppliers, each shape with copies under other keys."""
    import duckdb

    con = duckdb.connect()
    for name, key, step in (("part", "p_partkey", 518400), ("supplier", "s_suppkey", 7820 * 3)):
        con.execute(f"COPY (SELECT {key} + i * {step} AS {key} FROM '{SF}/{name}.parquet', range(3) r(i) WHERE {key} < 600) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return con


def test_copies_of_shapes_are_searched_once_and_counted_all(spark, duck, tmp_path):
    from oracle import compare

    from terralith.plans import shapes

    con, sf_dir = copied(spark, duck, tmp_path), str(tmp_path)
    pairs = con.sql(f"{shapes._with('parcels', 'estates')} SELECT count(*) FROM parcels a JOIN estates b ON {shapes._MEET}").fetchall()[0][0]
    assert shapes.met(spark, sf_dir).count() == pairs / 9
    for name in ("polygon_intersects", "join_contract", "largest_partner", "de9im_matrix", "clip_slivers", "roads_cross_parcels"):
        compare(catalog.queries()[name](spark, sf_dir), con, catalog.oracle_sql()[name])


def test_nearest_looks_once_a_place_and_no_further_than_it_must(spark):
    right = spark.range(4000).selectExpr("id AS pid", "CAST(id % 40 * 10 AS DOUBLE) AS x", "CAST(id div 40 % 50 * 10 AS DOUBLE) AS y")  # two at each place
    left = spark.createDataFrame([(k, 100.0, 100.0) for k in range(3)] + [(3, None, 1.0), (4, 5000.0, 0.0)], "pid long, x double, y double")
    seen = []
    near, spatial_join.join_near = spatial_join.join_near, lambda a, b, r: seen.append((a.count(), r)) or near(a, b, r)
    try:
        got = sorted((r["pid"], r["rank"], r["r_pid"]) for r in spatial_join.nearest(left, right, "pid", "pid", 3, 1000.0).collect())
    finally:
        spatial_join.join_near = near
    assert got == [(k, n, p) for k in range(3) for n, p in ((1, 410), (2, 2410), (3, 370))] + [(4, 1, 39), (4, 2, 2039), (4, 3, 79)]
    assert seen[0][0] == 2 and seen[0][1] < 20 and seen[-1][0] == 1


def test_clusters_and_weights_pair_places_not_copies(spark):
    from terralith.operators import inference, patterns

    copies = spark.createDataFrame([(10 * c + k, x, 0.0, float(k + c)) for c in range(5) for k, x in enumerate((0.0, 3.0, 50.0))], "pid long, x double, y double, weight double")
    sizes = []
    near, spatial_join.join_near = spatial_join.join_near, lambda a, b, r: sizes.append((a.count(), b.count())) or near(a, b, r)
    try:
        got = {r["pid"]: (r["core"], r["cluster"]) for r in patterns.dbscan(copies, 4.0, 6).collect()}
        m = inference.moran_within(copies, "weight", 4.0).first()
    finally:
        spatial_join.join_near = near
    assert got == {p: (True, 0) if p % 10 < 2 else (False, None) for p in got} and len(got) == 15
    assert max(max(s) for s in sizes) == 3
    rows = [(r["pid"], r["x"], r["weight"]) for r in copies.collect()]
    mean = sum(w for _, _, w in rows) / 15
    pairs = [(a[2] - mean) * (b[2] - mean) for a in rows for b in rows if a[0] != b[0] and abs(a[1] - b[1]) <= 4]
    assert m["n"] == 15 and m["w"] == len(pairs) and math.isclose(m["morans_i"], 15 * sum(pairs) / (len(pairs) * sum((w - mean) ** 2 for _, _, w in rows)))


def test_catchments_pair_places_not_copies(spark, tmp_path, monkeypatch):
    import duckdb
    from oracle import compare

    # keys 144000 apart lie at one place; some keys are repeated
    con = duckdb.connect()
    rows = lambda n, copies, twice: f"(SELECT k + c * 144000 AS k FROM range({n}) a(k), range({copies}) b(c) UNION ALL SELECT k FROM range({twice}) d(k))"
    con.execute(f"CREATE TABLE customer AS SELECT k AS c_custkey, 'BUILDING' AS c_mktsegment, 1.0 AS c_acctbal FROM {rows(700, 4, 50)}")
    con.execute(f"CREATE TABLE supplier AS SELECT k AS s_suppkey, k % 97 * 100.0 - 500 AS s_acctbal FROM {rows(60, 5, 7)}")
    for name in ("customer", "supplier"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    seen = []
    plain = spatial_join.join_near
    monkeypatch.setattr(spatial_join, "join_near", lambda a, b, *c: seen.append((a.count(), b.count())) or plain(a, b, *c))
    compare(catalog.queries()["two_step_access"](spark, str(tmp_path)), con, catalog.oracle_sql()["two_step_access"])
    assert seen and all(sorted(s) == [60, 700] for s in seen)


def test_fine_cells_find_the_same_pairs(spark):
    at = [(k, (k * 7919 % 2000 - 1000) / 10, (k * 104729 % 1999 - 1000) / 10) for k in range(400)] + [(400, 0.0, 0.0), (401, 30.0, 40.0), (402, -50.0, 0.0)]
    points = spark.createDataFrame(at, "pid int, x double, y double")
    want = {(a[0], b[0]) for a in at for b in at if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 2500}
    for fine in (1, 2, 4):
        got = [(r["pid"], r["r_pid"]) for r in spatial_join.join_near(points, points, 50.0, 3, fine).select("pid", "r_pid").collect()]
        assert len(got) == len(want) and set(got) == want


def test_corners_and_estates_with_copies_meet_once(spark, duck, tmp_path, monkeypatch):
    from oracle import compare

    con, sf_dir = copied(spark, duck, tmp_path), str(tmp_path)
    seen = []
    plain = spatial_join.pairs
    monkeypatch.setattr(spatial_join, "pairs", lambda a, b, *c: seen.append((a.count(), b.count())) or plain(a, b, *c))
    compare(catalog.queries()["within_or_covered"](spark, sf_dir), con, catalog.oracle_sql()["within_or_covered"])
    n = [con.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("part", "supplier")]
    assert len(seen) == 1 and all(3 * s <= m for s, m in zip(seen[0], n, strict=True))
