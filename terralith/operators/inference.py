"""Spatial weights and tests on them: edges (i, j, w) and values (zone_id, value) are tables throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators import spatial_join


def distance_band(points: DataFrame, key: str, radius: float) -> DataFrame:
    """i, j for every two different points at most radius apart."""
    p = points.select(key, "x", "y")
    return spatial_join.join_near(p, p, radius).where(F.col(key) != F.col(f"r_{key}")).select(F.col(key).alias("i"), F.col(f"r_{key}").alias("j"))


def nearest_weights(points: DataFrame, key: str, k: int, radius: float) -> DataFrame:
    """i, j of the k nearest other points of each, ties by key; rows that repeat a point are one."""
    p = points.select(key, "x", "y").distinct()
    found = spatial_join.nearest(p, p, key, key, k + 1, radius).where(F.col(key) != F.col(f"r_{key}"))
    order = Window.partitionBy(key).orderBy("d2", f"r_{key}")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(F.col(key).alias("i"), F.col(f"r_{key}").alias("j"))


def lag(values: DataFrame, edges: DataFrame) -> DataFrame:
    """zone_id, lag, n: mean of the neighbours' values that aren't null (row-standardised weights)."""
    v = values.select(F.col("zone_id").alias("j"), "value").where("value IS NOT NULL")
    means = edges.join(v, "j").groupBy(F.col("i").alias("zone_id")).agg(F.avg("value").alias("lag"), F.count("*").alias("n"))
    return values.select("zone_id").join(means, "zone_id", "left").select("zone_id", "lag", F.coalesce("n", F.lit(0)).alias("n"))


def scores(values: DataFrame) -> DataFrame:
    """zone_id, z (population standard score) of the zones that hold a value."""
    whole = values.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    held = values.where("value IS NOT NULL").join(F.broadcast(whole))
    return held.select("zone_id", ((F.col("value") - F.col("m")) / F.when(F.col("s") > 0, F.col("s"))).alias("z"))


def local_moran(values: DataFrame, edges: DataFrame) -> DataFrame:
    """zone_id, z, lag_z, local_i and the quadrant (HH, LL, HL, LH) of each zone with a neighbour."""
    z = scores(values)
    around = edges.join(z.select(F.col("zone_id").alias("j"), F.col("z").alias("zj")), "j").groupBy(F.col("i").alias("zone_id")).agg(F.avg("zj").alias("lag_z"))
    side = lambda c: F.when(F.col(c) >= 0, "H").otherwise("L")
    return z.join(around, "zone_id").select("zone_id", "z", "lag_z", (F.col("z") * F.col("lag_z")).alias("local_i"), F.concat(side("z"), side("lag_z")).alias("quadrant"))


def shuffled(values: DataFrame, rounds: int) -> DataFrame:
    """round, zone_id, value: in each round the values dealt anew by an arithmetic rule, the same in every run."""
    v = values.where("value IS NOT NULL").select("zone_id", "value", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    mixed = (F.col("zone_id") * 7919 + F.col("round") * 104729 + F.col("zone_id") * F.col("zone_id") * F.col("round") * 31) % 10007
    dealt = v.withColumn("to", F.row_number().over(Window.partitionBy("round").orderBy(mixed, "zone_id")))
    own = v.withColumn("at", F.row_number().over(Window.partitionBy("round").orderBy("zone_id")))
    return own.select("round", "zone_id", F.col("at").alias("to")).join(dealt.select("round", "value", "to"), ["round", "to"]).drop("to")


def moran_by_round(dealt: DataFrame, edges: DataFrame) -> DataFrame:
    """round, morans_i of values dealt in rounds, over binary edges."""
    whole = dealt.groupBy("round").agg(F.avg("value").alias("m"), F.count("*").alias("n"), F.var_pop("value").alias("v"))
    z = dealt.join(F.broadcast(whole.select("round", "m")), "round").select("round", "zone_id", (F.col("value") - F.col("m")).alias("z"))
    a, b = z.select("round", F.col("zone_id").alias("i"), F.col("z").alias("zi")), z.select("round", F.col("zone_id").alias("j"), F.col("z").alias("zj"))
    cross = edges.join(a, "i").join(b, ["round", "j"]).groupBy("round").agg(F.sum(F.col("zi") * F.col("zj")).alias("c"), F.count("*").alias("w"))
    return cross.join(whole, "round").select("round", (F.col("c") / (F.col("w") * F.col("v"))).alias("morans_i"))


def standardised_moran_by_round(dealt: DataFrame, edges: DataFrame) -> DataFrame:
    """round, morans_i with row-standardised weights; rows without a value take no part, and a zone's weights are shared
    among its neighbours that have one."""
    held = dealt.where("value IS NOT NULL")
    whole = held.groupBy("round").agg(F.avg("value").alias("m"))
    z = held.join(F.broadcast(whole), "round").select("round", "zone_id", (F.col("value") - F.col("m")).alias("z"))
    lag = edges.join(z.select("round", F.col("zone_id").alias("j"), F.col("z").alias("zj")), "j").groupBy("round", F.col("i").alias("zone_id")).agg(F.avg("zj").alias("lag"))
    each = z.join(lag, ["round", "zone_id"], "left").groupBy("round")
    i = F.count("*") / F.count("lag") * F.sum(F.col("z") * F.col("lag")) / F.sum(F.col("z") * F.col("z"))
    return each.agg(i.alias("morans_i"))


def permutation_p(rounds: DataFrame) -> DataFrame:
    """observed (round 0), z_sim, p: twice the rarer side of all dealings, of one more than these, at most 1."""
    own = rounds.where("round = 0").select(F.col("morans_i").alias("own"))
    s = rounds.where("round > 0").join(F.broadcast(own))
    side = lambda test: F.count_if(test)
    i, o = F.round("morans_i", 9), F.round("own", 9)
    p = (1 + 2 * F.least(side(i >= o), side(i <= o))) / (F.count("*") + 1)
    return s.agg(F.max("own").alias("observed"), ((F.max("own") - F.avg("morans_i")) / F.stddev_samp("morans_i")).alias("z_sim"), F.least(F.lit(1.0), p).alias("p"))


def two_sided(z: Column) -> Column:
    """Chance of a normal deviate beyond |z|, by a rational approximation good to 1e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(z) / F.sqrt(F.lit(2.0)))
    powers = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return powers * F.exp(-z * z / 2)


def adjusted(tests: DataFrame, p: str, alpha: float) -> DataFrame:
    """tests with bonferroni and fdr (Benjamini-Hochberg): whether each p counts at level alpha.

    The greatest p with p <= alpha * rank / n is found from counted p values, so one row a distinct p is sorted.
    """
    from terralith.operators.statistics import value_ranks

    one = tests.withColumn("__all", F.lit(1))
    ranks = value_ranks(one.where(F.col(p).isNotNull()), "__all", p)
    cut = ranks.where(F.col(p) <= alpha * (F.col("below") + F.col("m")) / F.col("n")).agg(F.max(p).alias("__cut"))
    n = one.agg(F.count(p).alias("__n"))
    out = tests.join(F.broadcast(cut)).join(F.broadcast(n))
    flags = [F.coalesce(F.col(p) <= alpha / F.col("__n"), F.lit(False)).alias("bonferroni"), F.coalesce(F.col(p) <= F.col("__cut"), F.lit(False)).alias("fdr")]
    return out.select(*tests.columns, *flags)


def moran_within(points: DataFrame, value: str, radius: float) -> DataFrame:
    """n, w, morans_i of points (x, y) whose neighbours are all others within a radius. Points at one place enter with
    their number and sum, so pairs are of places; none is stored."""
    mean = points.agg(F.avg(value).alias("__mean"))
    z = points.join(F.broadcast(mean)).select("x", "y", (F.col(value) - F.col("__mean")).alias("z"))
    at = z.groupBy("x", "y").agg(F.count("*").alias("m"), F.sum("z").alias("z"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    pairs = spatial_join.join_near(at, at, radius)
    both = pairs.agg(F.sum(F.col("m") * F.col("r_m")).alias("w"), F.sum(F.col("z") * F.col("r_z")).alias("c"))
    own = at.agg(F.sum("m").alias("n"), F.sum("zz").alias("zz"))
    # a point isn't its own neighbour
    t = own.join(F.broadcast(both)).select("n", (F.col("w") - F.col("n")).alias("w"), (F.col("c") - F.col("zz")).alias("c"), "zz")
    return t.select("n", "w", (F.col("n") * F.col("c") / (F.col("w") * F.col("zz"))).alias("morans_i"))
