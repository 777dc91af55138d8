"""Point patterns, clusters and accessibility from pairs within a radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.operators import graph, spatial_join


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """pid, core, cluster of points (pid, x, y): clusters are components of core points, named by their least
    pid; a border point takes the least cluster in reach; noise has none. A point counts itself."""
    p = points.select("pid", "x", "y")
    # copies of a place are all core or all not, and of one cluster: pairs are of places and none is stored
    at = graph.cut(p.groupBy("x", "y").agg(F.min("pid").alias("pid"), F.count("*").alias("m")))
    core = spatial_join.join_near(at, at, eps).groupBy("x", "y", "pid").agg(F.sum("r_m").alias("m")).where(F.col("m") >= least).drop("m")
    # core points of one cell are in reach of each other, so the cells are what is linked
    side = 0.7 * eps
    core = graph.cut(core.withColumn("cell", F.struct(spatial_join.cell(F.col("x"), side).alias("i"), spatial_join.cell(F.col("y"), side).alias("j"))))
    cells = core.groupBy("cell").agg(F.min("pid").alias("node"))
    core = graph.cut(core.join(cells, "cell").drop("cell"))
    linked = graph.components(spatial_join.join_near(core, core, eps).where("node < r_node").select(F.col("node").alias("a"), F.col("r_node").alias("b")).distinct())
    named = core.join(linked, "node", "left").select("x", "y", F.coalesce("component", "node").alias("cluster"))
    border = at.join(core, ["x", "y"], "left_anti")
    reach = spatial_join.join_near(border, named, eps).groupBy("x", "y").agg(F.min("r_cluster").alias("c"))
    out = p.join(named, ["x", "y"], "left").join(reach, ["x", "y"], "left")
    return out.select("pid", F.col("cluster").isNotNull().alias("core"), F.coalesce("cluster", "c").alias("cluster"))


def two_step_access(demand: DataFrame, supply: DataFrame, radius: float) -> DataFrame:
    """pid, access of demand (pid, x, y, weight) to supply (pid, x, y, weight) within a radius, by Gaussian decay.

    Step one: each supply over the demand it can reach. Step two: the sum of these in reach; 0 if none is.
    Both steps are sums over pairs of places, and no pair is stored.
    """
    at = graph.cut(demand.groupBy("x", "y").agg(F.sum("weight").alias("weight")))
    stops = graph.cut(supply.select("x", "y").distinct())
    tasks = 4 * demand.sparkSession.sparkContext.defaultParallelism
    g = F.exp(-0.5 * 4 * F.col("d2") / (radius * radius))
    reached = graph.cut(spatial_join.join_near(stops, at, radius, tasks, 4).groupBy("x", "y").agg(F.sum(F.col("r_weight") * g).alias("reach")))
    # rows of one key are one supply
    rate = supply.join(reached, ["x", "y"]).groupBy("pid").agg((F.max("weight") / F.sum("reach")).alias("rate"))
    offers = graph.cut(supply.join(reached, ["x", "y"]).join(rate, "pid").groupBy("x", "y").agg(F.sum("rate").alias("rate")))
    got = spatial_join.join_near(offers, at.select("x", "y"), radius, tasks, 4).groupBy("r_x", "r_y").agg(F.sum(F.col("rate") * g).alias("access"))
    got = demand.join(got.withColumnsRenamed({"r_x": "x", "r_y": "y"}), ["x", "y"]).groupBy("pid").agg(F.sum("access").alias("access"))
    return demand.select("pid").join(got, "pid", "left").select("pid", F.coalesce("access", F.lit(0.0)).alias("access"))


def semivariogram(points: DataFrame, lag: float, radius: float) -> DataFrame:
    """lag (number of the bin), pairs, gamma: half the mean squared difference of weight over pairs of a distance."""
    p = points.select("pid", "x", "y", "weight")
    gap = F.col("weight") - F.col("r_weight")
    pairs = spatial_join.join_near(p, p, radius).where("pid < r_pid").withColumn("lag", F.floor(F.sqrt("d2") / lag).cast("int"))
    return pairs.groupBy("lag").agg(F.count("*").alias("pairs"), (F.avg(gap * gap) / 2).alias("gamma"))


def clark_evans(points: DataFrame, area: float, radius: float) -> DataFrame:
    """n, observed and expected mean distance to the nearest other point, their ratio and z."""
    near = spatial_join.nearest(points.select("pid", "x", "y"), points.select("pid", "x", "y"), "pid", "pid", k=2, radius=radius)
    d = near.where("pid <> r_pid").groupBy("pid").agg(F.sqrt(F.min("d2")).alias("d")).agg(F.count("*").alias("n"), F.avg("d").alias("observed"))
    expected, n = 0.5 * F.sqrt(area / F.col("n")), F.col("n")
    return d.select("n", "observed", expected.alias("expected"), (F.col("observed") / expected).alias("ratio"), ((F.col("observed") - expected) / (0.26136 / F.sqrt(n * n / area))).alias("z"))


def quadrats(points: DataFrame, size: float, total: int) -> DataFrame:
    """n, variance to mean ratio and chi-square of counts in square quadrats, total in all, empty ones included."""
    n = spatial_join.with_cell(points, size).groupBy("cx", "cy").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"))
    mean: Column = F.col("n") / total
    around = F.col("q") - F.col("n") * mean
    return n.select("n", (around / (total - 1) / mean).alias("vmr"), (around / mean).alias("chi2"))
