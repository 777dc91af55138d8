import pytest
from oracle import compare

from terralith import catalog

SF = "/root/testdata/sf0.01"


#: Thinning and trees have no SQL; test_arrangement.py and test_models.py hold their parts against brute force.
WITHOUT_SQL = ["external_auc", "importance_by_fold", "model_comparison", "partial_dependence", "region_round_trip", "risk_surface", "thinned_region_rings"]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    compare(catalog.queries()[name](spark, SF), duck, catalog.oracle_sql()[name])


def test_which_queries_have_no_sql():
    assert sorted(set(catalog.queries()) - set(catalog.oracle_sql())) == WITHOUT_SQL


def test_scores_and_surfaces_keep_their_ranges(spark):
    s = catalog.queries()["risk_surface"](spark, SF).selectExpr("count(*) AS n", "min(score) AS a", "max(score) AS b", "min(spread) AS c", "max(spread) AS d").first()
    assert s["n"] > 1000 and 0 <= s["a"] < s["b"] <= 1 and 0 <= s["c"] <= s["d"] <= 0.5
    d = [r["mean_score"] for r in catalog.queries()["partial_dependence"](spark, SF).orderBy("value").collect()]
    assert len(d) == 9 and d[-1] > d[0] + 0.3


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 24


def test_utm_agrees_with_a_known_point(spark):
    from pyspark.sql import functions as F

    from terralith.functions import crs

    # on the central meridian the easting is 500 km, the northing the scaled meridian arc
    x, y = crs.utm(F.lit(15.0), F.lit(45.0), 15.0)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r["x"] - 500_000) < 1e-3 and abs(r["y"] - 0.9996 * 4984944.378) < 0.01


def test_nearest_equals_brute_force_on_ties_and_far_points(spark):
    from terralith.operators import spatial_join

    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 90000.0, 0.0)], "pid long, x double, y double")
    right = spark.createDataFrame([(7, 1.0, 0.0), (5, -1.0, 0.0), (9, 500.0, 0.0)], "pid long, x double, y double")
    got = {(r["pid"], r["rank"]): r["r_pid"] for r in spatial_join.nearest(left, right, "pid", "pid", k=2, radius=10.0).collect()}
    assert got == {(1, 1): 5, (1, 2): 7, (2, 1): 9, (2, 2): 7}


def test_network_reach_all_follows_chains_of_any_length(spark):
    import heapq
    import math

    from terralith.plans import analysis

    # a bent chain of nine legs, a detour that is nearer by more legs, a second source, and a point no leg reaches
    places = [("SUPPLIER", 0.0, 0.0), *[("A", 1400.0 * k, 200.0 * (k % 3)) for k in range(1, 10)], ("B", 700.0, 100.0), ("B", 2100.0, 200.0), ("SUPPLIER", 30000.0, 0.0), ("A", 31000.0, 0.0), ("A", 90000.0, 0.0), ("A", 1400.0, 200.0)]
    xy = sorted({(x, y) for _, x, y in places})
    best = {(x, y): 0.0 for k, x, y in places if k == "SUPPLIER"}
    heap = [(0.0, p) for p in best]
    while heap:
        d, p = heapq.heappop(heap)
        for q in xy:
            w = math.dist(p, q)
            if q != p and w <= 1500 and d + w < best.get(q, math.inf):
                best[q] = d + w
                heapq.heappush(heap, (d + w, q))
    points = spark.createDataFrame([(k, *p, 1.0) for k, p in enumerate(places)], "pid long, kind string, x double, y double, weight double")
    got = {r["node"]: r["distance"] for r in analysis.reach(points).collect()}
    assert got.keys() == {x * 100000 + y for x, y in best} and len(got) == 14
    assert all(math.isclose(got[x * 100000 + y], d, abs_tol=1e-6) for (x, y), d in best.items())
    # sf0.01 has 40 places further than four legs away
    n = {q.__name__: sum(r["n"] for r in q(spark, SF).collect()) for q in (analysis.network_reach, analysis.network_reach_all)}
    assert n == {"network_reach": 973, "network_reach_all": 1013}
