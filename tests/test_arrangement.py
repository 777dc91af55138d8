"""Arrangements, regions and Voronoi cells against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from terralith.functions import geometry
from terralith.operators import arrangement, hulls, overlay, raster, tessellation
from terralith.plans import overlays

RINGS = "k int, rings array<array<struct<x:double,y:double>>>"
SEGMENT = "g int, p int, sid string, ax double, ay double, bx double, by double"


def even_odd_area(rings):
    """By vertical slabs between all corners and crossings."""
    edges = [(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))]
    xs = {p[0] for e in edges for p in e}
    for i, (a, b) in enumerate(edges):
        for c, d in edges[:i]:
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if den:
                t, u = ((c[0] - a[0]) * (q[1]) - (c[1] - a[1]) * q[0] for q in ((d[0] - c[0], d[1] - c[1]), (b[0] - a[0], b[1] - a[1])))
                if 0 <= t / den <= 1 and 0 <= u / den <= 1:
                    xs.add(a[0] + t / den * (b[0] - a[0]))
    total, xs = 0.0, sorted(xs)
    for x0, x1 in zip(xs, xs[1:], strict=False):
        m = (x0 + x1) / 2
        ys = sorted(a[1] + (m - a[0]) / (b[0] - a[0]) * (b[1] - a[1]) for a, b in edges if (a[0] > m) != (b[0] > m))
        total += (x1 - x0) * sum(q - p for p, q in zip(ys[::2], ys[1::2], strict=True))
    return total


def net_area():
    return F.sum(F.col("size") - F.aggregate("holes", F.lit(0.0), lambda a, h: a + geometry.area(h)))


def test_rings_that_cross_themselves(spark):
    pick = random.Random(1)
    point = lambda: (pick.random() * 1000, pick.random() * 1000)
    rows = [(k, [[point() for _ in range(pick.randint(5, 30))]]) for k in range(14)]
    # a figure of two rings, one inside the other; a ring drawn twice is nothing; a ring that folds back
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rows += [(90, [square(0.0, 10.0), square(2.0, 5.0)]), (91, [square(0.0, 10.0), square(0.0, 10.0)]), (92, [[(0.0, 0.0), (10.0, 0.0), (5.0, 0.0), (5.0, 5.0)]])]
    got = {r[0]: (r[1], r[2]) for r in arrangement.even_odd(spark.createDataFrame(rows, RINGS), "k", 200.0).groupBy("k").agg(net_area(), F.sum(F.size("holes"))).collect()}
    for k, rings in rows[:14]:
        assert abs(got[k][0] - even_odd_area(rings)) < 0.05, k
    assert abs(got[90][0] - 91) < 1e-6 and got[90][1] == 1 and 91 not in got and abs(got[92][0] - 12.5) < 1e-6


def test_lines_cross_only_at_nodes(spark):
    pick = random.Random(2)
    rows = [(0, k, str(k), *[pick.randint(0, 100) * 10.0 for _ in range(4)]) for k in range(60)]
    pieces = [tuple(r) for r in arrangement.noded(spark.createDataFrame(rows, SEGMENT), 150.0).select("x0", "y0", "x1", "y1").distinct().collect()]
    scaled = [tuple(c * arrangement.GRID for c in p) for p in pieces]
    turn = lambda p, x, y: (p[2] - p[0]) * (y - p[1]) - (p[3] - p[1]) * (x - p[0])
    for i, p in enumerate(scaled):
        for q in scaled[:i]:
            sides = [turn(p, *q[:2]), turn(p, *q[2:]), turn(q, *p[:2]), turn(q, *p[2:])]
            assert not (sides[0] * sides[1] < -1e-2 and sides[2] * sides[3] < -1e-2), (p, q)
    long = sum(np.hypot(p[2] - p[0], p[3] - p[1]) for p in scaled)
    assert long <= sum(np.hypot(r[5] - r[3], r[6] - r[4]) for r in rows) + 1


def test_overlay_adds_up(spark):
    pick = random.Random(3)

    def layer(key, n, size):
        rows = []
        for k in range(n):
            x, y = pick.random() * 800, pick.random() * 800
            turns = sorted(pick.random() * 2 * np.pi for _ in range(pick.randint(3, 9)))
            ring = [(x + size * np.cos(t).item(), y + size * np.sin(t).item()) for t in turns]
            rows.append((k, [(ring, [])], *[float(f([p[c] for p in ring])) for f in (min, max) for c in (0, 1)]))
        parts = "parts array<struct<shell:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>>"
        return spark.createDataFrame(rows, f"{key} long, {parts}, xmin double, ymin double, xmax double, ymax double")

    # the right layer's polygons don't overlap each other, so that shares add up to the left ones
    left, right = layer("a", 25, 120.0), layer("b", 1, 300.0)
    area = F.aggregate("parts", F.lit(0.0), lambda t, p: t + geometry.area(p["shell"]))
    u = overlay.union(left, right, "a", "b", 100.0).cache()
    for df, key in ((left, "a"), (right, "b")):
        whole = {r[0]: r[1] for r in df.select(key, area).collect()}
        if key == "a":
            got = {r[0]: r[1] for r in u.where("a IS NOT NULL").groupBy("a").agg(F.sum("area")).collect()}
            assert set(got) == set(whole) and all(abs(got[k] - whole[k]) < 1e-2 for k in whole)
    rest = {r[0]: r[1] for r in overlay.difference(left, right, "a", "b", 100.0).groupBy("a").agg(net_area()).collect()}
    alone = {r[0]: r[1] for r in u.where("a IS NOT NULL AND b IS NULL").select("a", "area").collect()}
    assert set(rest) == set(alone) and all(abs(rest[k] - alone[k]) < 1e-2 for k in rest)


def test_chains_and_loops_merge(spark):
    at = lambda *v: [(0, *v[k : k + 2], *v[k + 2 : k + 4]) for k in range(0, len(v) - 2, 2)]
    rows = at(0, 0, 1, 0, 2, 0, 2, 1) + at(2, 1, 3, 1) + at(2, 1, 2, 2, 1, 2)  # a junction at (2, 1)
    rows += at(10, 10, 11, 10, 11, 11, 10, 11, 10, 10) + at(20, 20, 21, 20)
    loop = [(0, 30 + round(5 * np.cos(t)), 30 + round(5 * np.sin(t))) for t in np.linspace(0, 2 * np.pi, 20, endpoint=False)]
    rows += [(0, *p[1:], *q[1:]) for p, q in zip(loop, loop[1:] + loop[:1], strict=True)]
    m = arrangement.merged_lines(spark.createDataFrame(rows, "g int, x0 long, y0 long, x1 long, y1 long")).collect()
    assert sorted((len(r["line"]), r["closed"]) for r in m) == [(2, False), (2, False), (3, False), (4, False), (5, True), (21, True)]


def test_regions_burn_back_to_their_cells(spark):
    pick = random.Random(4)
    rows = [(r, c, 1.0) for r in range(14) for c in range(17) if pick.random() < 0.62]
    cells = raster.patches(spark.createDataFrame(rows, "row int, col int, value double"), 17).cache()
    polygons = raster.regions(cells, "patch", 10.0).cache()
    back = {tuple(r) for r in raster.burned(polygons, "patch", 10.0).collect()}
    assert back == {(r["patch"], r["row"], r["col"]) for r in cells.collect()}
    assert polygons.agg(F.max(F.size("holes"))).first()[0] > 0 and polygons.count() == cells.select("patch").distinct().count()


def test_thinned_rings_keep_their_shape(spark):
    stairs = [(0.0, 0.0), (10.0, 0.0)] + [(10.0 - k / 2, 1.0 + k / 2 + (k % 2) * 0.1) for k in range(18)]
    df = spark.createDataFrame([(1, stairs), (2, stairs[:3]), (3, [])], "k int, ring array<struct<x:double,y:double>>")
    got = {r["k"]: r["t"] for r in df.select("k", hulls.simplified_ring(F.col("ring"), 0.5).alias("t")).collect()}
    assert 3 <= len(got[1]) < 6 and len(got[2]) == 3 and got[3] == []


def test_voronoi_cells_equal_clipping_by_all_seeds(spark):
    rng = np.random.default_rng(6)
    seeds = np.vstack([rng.random((60, 2)) * 1000, rng.random((40, 2)) * 10 + 500])  # a dense cluster

    def clip(ring, a, b):
        m, d, out = (a + b) / 2, b - a, []
        side = lambda p: np.dot(p - m, d)
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            if side(p) <= 0:
                out.append(p)
            if (side(p) < 0) != (side(q) < 0):
                out.append(p + side(p) / (side(p) - side(q)) * (q - p))
        return out

    box = [np.array(v, float) for v in ((0, 0), (1000, 0), (1000, 1000), (0, 1000))]
    want = {}
    for k, s in enumerate(seeds):
        ring = box
        for j, o in enumerate(seeds):
            ring = clip(ring, s, o) if j != k else ring
        want[k] = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    df = spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(seeds)], "id int, x double, y double")
    mask = geometry.box(*[F.lit(float(v)) for v in (0, 0, 1000, 1000)])
    got = {r["id"]: r["a"] for r in tessellation.voronoi(df, "id", mask, 6).select("id", geometry.area(F.col("ring")).alias("a")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_empty_layers(spark):
    none = spark.createDataFrame([], SEGMENT)
    assert arrangement.noded(none).count() == arrangement.sides(none).count() == 0
    assert arrangement.even_odd(spark.createDataFrame([], RINGS), "k").count() == 0


def test_round_trip_loses_little_of_large_regions(spark):
    rows = overlays.region_round_trip(spark, "/root/testdata/sf0.01").collect()
    assert all(r["n_cells"] - r["lost"] >= 0 for r in rows) and {r["cell_m"] for r in rows} == {1000, 500, 250}
    squares = [r for r in rows if abs(r["compactness"] - np.pi / 4) < 1e-5]
    assert squares and all(r["error"] == 0 for r in squares)


def test_copies_of_a_ring_are_repaired_once(spark, tmp_path, monkeypatch):
    spark.range(1, 1001).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    seen = []
    plain = arrangement.even_odd
    monkeypatch.setattr(arrangement, "even_odd", lambda d, *a: seen.append(d.count()) or plain(d, *a))
    got = overlays.make_valid(spark, str(tmp_path))
    assert seen == [200] and got.count() == 1000


def test_relations_are_worked_out_once_for_pairs_alike(spark, tmp_path, monkeypatch):
    from terralith.operators import spatial_join

    # keys 518400 apart have equal plots
    spark.range(1, 4001).selectExpr("explode(array(id, id + 518400)) AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 201).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    seen = []
    plain = spatial_join.spread
    monkeypatch.setattr(spatial_join, "spread", lambda d: seen.append(d.count()) or plain(d))
    n = overlays.notched_relations(spark, str(tmp_path)).count()
    assert 0 < seen[0] < n


def test_a_tile_of_a_shape_is_clipped_once(spark):
    from terralith.sources import layers

    spark.range(1, 2881).selectExpr("id AS p_partkey").createOrReplaceTempView("__part")
    part = spark.table("__part").selectExpr("p_partkey AS k").selectExpr("k AS plot_id", *[f"{e} AS {c}" for c, e in layers.PARCEL.items()])
    part = part.withColumn("parts", F.expr(layers._shape("plots", "plot_id")))
    one, every = overlay._distinct(part.unionByName(part.withColumn("plot_id", F.col("plot_id") + 10000)), "plot_id")
    rows, kinds = overlay._clipped(one, 100.0)
    assert one.count() == 2880 and every.count() == 5760 and kinds.count() < 800 < rows.count()


def test_voronoi_cells_count_copies_of_places_and_keys(spark, tmp_path):
    import duckdb
    from oracle import compare

    # keys 144000 apart lie at one place; some keys are repeated
    con = duckdb.connect()
    rows = lambda n, copies, twice: f"(SELECT k + c * 144000 AS k FROM range({n}) a(k), range({copies}) b(c) UNION ALL SELECT k FROM range({twice}) d(k))"
    con.execute(f"CREATE TABLE customer AS SELECT k AS c_custkey, 'BUILDING' AS c_mktsegment, 1.0 AS c_acctbal FROM {rows(700, 3, 50)}")
    con.execute(f"CREATE TABLE supplier AS SELECT k AS s_suppkey, 1.0 AS s_acctbal FROM {rows(40, 30, 5)}")
    for name in ("customer", "supplier"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    compare(overlays.voronoi_cells(spark, str(tmp_path)), con, overlays.queries.sql["voronoi_cells"])


def test_a_search_takes_as_many_tasks_as_its_circles_need(spark, monkeypatch):
    from terralith.operators import spatial_join

    at = np.random.default_rng(8).random((3000, 2)) * 20000
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "id int, x double, y double")
    seen = []
    plain = spatial_join.join_near
    monkeypatch.setattr(spatial_join, "join_near", lambda *a: seen.append(a[3]) or plain(*a))
    got = spatial_join.nearest(points, points, "id", "id", 64, 20000.0).select("id", "rank", "r_id").collect()
    assert seen[0] >= 3 and len(got) == 3000 * 64  # 256 rows a circle
    for k in range(0, 3000, 300):
        d2 = ((at - at[k]) ** 2).sum(axis=1)
        assert {r["r_id"] for r in got if r["id"] == k} == set(np.argsort(d2)[:64].tolist())


def test_what_is_left_takes_a_shape_once_and_what_covers_a_tile_alone(spark, tmp_path, monkeypatch):
    import duckdb
    from oracle import compare

    # plots 518400 apart are equal, yards 23460 apart too; yards overlap each other about four times, without copies
    con = duckdb.connect()
    for name, key, n, step in (("part", "p_partkey", 400, 518400), ("supplier", "s_suppkey", 4000, 23460)):
        con.execute(f"CREATE TABLE {name} AS SELECT k + c * {step} AS {key} FROM range({n}) a(k), range(3) b(c)")
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    seen = []
    plain = arrangement.sides
    monkeypatch.setattr(arrangement, "sides", lambda s, *a: seen.append(s.select("g", "p").distinct().count()) or plain(s, *a))
    compare(overlays.overlay_erase(spark, str(tmp_path)), con, overlays.queries.sql["overlay_erase"])
    assert 0 < sum(seen) < 800
