"""Edges of hulls, set-backs, inner points, thinned lines and scores."""

import numpy as np
from pyspark.sql import functions as F

from terralith.functions import geometry
from terralith.operators import assessment, hulls


def brute_hull(xy):
    """Corners by the definition: points that no segment or triangle of the others holds, found by edges with all on one side."""
    pts = sorted({tuple(p) for p in xy})
    if len(pts) < 3:
        return set(pts)
    turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    between = lambda a, b, p: turn(a, b, p) == 0 and min(a, b) < p < max(a, b)
    ends = {e for a in pts for b in pts if a != b and all(turn(a, b, p) >= 0 for p in pts) for e in (a, b)}
    return {p for p in ends if not any(between(a, b, p) for a in pts for b in pts)}


def test_hull_equals_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 12, 40):
        for top in (2, 4, 30):
            xy = rng.integers(0, top, (n, 2)).astype(float)
            assert {tuple(p) for p in hulls.hull(xy).tolist()} == brute_hull(xy.tolist())
    many = rng.integers(0, 40, (300, 2)).astype(float)
    assert {tuple(p) for p in hulls.hull(many).tolist()} == {tuple(p) for p in hulls.hull(np.r_[hulls.hull(many[:150]), hulls.hull(many[150:])]).tolist()}
    line = np.column_stack([np.arange(200.0), np.arange(200.0)])
    assert hulls.hull(line).tolist() == [[0.0, 0.0], [199.0, 199.0]]


def test_hulls_of_groups_with_nulls(spark):
    rows = [("a", float(x), float(y), 1) for x in range(9) for y in range(9)] * 3 + [(None, 0.0, 0.0, 1), (None, 1.0, 0.0, 1), ("b", None, 2.0, 1), ("c", 5.0, 5.0, 1)]
    d = spark.createDataFrame(rows, "kind string, x double, y double, part int").repartition(7)
    got = {r["kind"]: [tuple(p) for p in r["ring"]] for r in hulls.convex_hulls(d, "kind").collect()}
    assert got == {"a": [(0, 0), (8, 0), (8, 8), (0, 8)], None: [(0, 0), (1, 0)], "c": [(5, 5)]}
    assert hulls.convex_hulls(d.where("false"), "kind").count() == 0


def test_simplify_keeps_ends_and_closed_lines(spark):
    lines = [(1, [(0, 0), (1, 0), (2, 0)]), (2, [(0, 0), (1, 5), (2, 0)]), (3, []), (4, None), (5, [(0, 0), (4, 0), (4, 4), (0, 0)]), (6, [(1, 1)]), (7, [(2, 2)] * 4)]
    d = spark.createDataFrame([(i, None if p is None else [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in lines], "id int, line array<struct<x:double,y:double>>")
    got = {r["id"]: r["at"] for r in d.select("id", hulls.simplify(F.col("line"), 1.0).alias("at")).collect()}
    assert got == {1: [0, 2], 2: [0, 1, 2], 3: [], 4: None, 5: [0, 1, 2, 3], 6: [0], 7: [0, 3]}


def test_eroded_and_inner_points(spark):
    square = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D), named_struct('x', 10D, 'y', 10D), named_struct('x', 0D, 'y', 10D))")
    flat = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D))")
    d = spark.range(1).select(square.alias("ring"), flat.alias("flat"))
    r = d.select(
        geometry.area(geometry.eroded(F.col("ring"), F.lit(2.0))).alias("left"), F.size(geometry.eroded(F.col("ring"), F.lit(6.0))).alias("gone"),
        geometry.eroded(F.col("ring"), F.lit(None).cast("double")).isNull().alias("unknown"), geometry.representative(F.col("ring")).alias("p"), geometry.representative(F.col("flat")).alias("none"),
    ).first()
    assert r["left"] == 36 and r["gone"] == 0 and tuple(r["p"]) == (5, 5) and r["none"] is None


def test_scores_of_one_class_and_decay(spark):
    d = spark.createDataFrame([(0.2, True), (0.8, True), (None, True), (0.3, None)], "score double, hit boolean")
    m = assessment.score_metrics(assessment.by_score(d, "score", "hit", 10), 10).selectExpr("n", "hits", "try_cast(average_precision AS double) AS ap").first()
    assert (m["n"], m["hits"], m["ap"]) == (2, 2, 1.0)
    rows = spark.createDataFrame([(float(x), 3 + 7 * float(np.exp(-x / 6))) for x in range(30)] + [(None, 1.0)], "x double, y double")
    f = assessment.decay_fit(rows, "x", "y", [2.0, 4.0, 6.0, 8.0]).first()
    assert f["length"] == 6 and abs(f["a"] - 3) < 1e-9 and abs(f["b"] - 7) < 1e-9 and abs(f["r2"] - 1) < 1e-9


def test_equal_lines_are_thinned_once_and_files_are_bounded(spark, tmp_path, monkeypatch):
    from terralith.operators import spatial_join
    from terralith.plans import derived
    from terralith.sources import formats

    spark.range(1, 501).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    seen = []
    plain = spatial_join.spread
    monkeypatch.setattr(spatial_join, "spread", lambda d: seen.append(d.count()) or plain(d))
    assert derived.simplified_lines(spark, str(tmp_path)).count() == 500 and seen == [23]
    assert formats.in_files(spark.range(500).coalesce(1), 100).rdd.getNumPartitions() == 5
    assert formats.in_files(spark.range(0)).rdd.getNumPartitions() == 1
