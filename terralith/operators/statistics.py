"""Spatial and distribution statistics as joins and aggregates over edge lists and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid_contiguity(zones: DataFrame, columns: int) -> DataFrame:
    """i, j of queen neighbours among zones numbered row by row: an equi-join on the shifted cell."""
    z = zones.select(F.col("zone_id").alias("i"), (F.col("zone_id") % columns).alias("c"), F.floor(F.col("zone_id") / columns).alias("r"))
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    near = z.select("i", "c", "r", F.explode(step).alias("dc")).select("*", F.explode(step).alias("dr")).where("dc <> 0 OR dr <> 0").select("i", (F.col("c") + F.col("dc")).alias("c"), (F.col("r") + F.col("dr")).alias("r"))
    return near.join(z.select(F.col("i").alias("j"), "c", "r"), ["c", "r"]).select("i", "j")


def morans_i(values: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n, total weight and Moran's I of values (zone_id, value) over binary edges (i, j)."""
    mean = values.agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    z = values.join(F.broadcast(mean)).select("zone_id", (F.col("value") - F.col("m")).alias("z"), "n")
    a, b = z.select(F.col("zone_id").alias("i"), F.col("z").alias("zi")), z.select(F.col("zone_id").alias("j"), F.col("z").alias("zj"))
    cross = edges.join(a, "i").join(b, "j").agg(F.sum(F.col("zi") * F.col("zj")).alias("cross"), F.count("*").alias("w"))
    own = z.agg(F.sum(F.col("z") * F.col("z")).alias("own"), F.max("n").alias("n"))
    return cross.join(F.broadcast(own)).select("n", "w", (F.col("n") * F.col("cross") / (F.col("w") * F.col("own"))).alias("morans_i"))


def getis_ord(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Gi* of every zone: its own value and its neighbours' against the whole."""
    whole = values.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n"))
    with_self = edges.union(values.select(F.col("zone_id").alias("i"), F.col("zone_id").alias("j")))
    sums = with_self.join(values.select(F.col("zone_id").alias("j"), "value"), "j").groupBy("i").agg(F.sum("value").alias("t"), F.count("*").alias("w"))
    g = (F.col("t") - F.col("m") * F.col("w")) / (F.col("s") * F.sqrt((F.col("n") * F.col("w") - F.col("w") * F.col("w")) / (F.col("n") - 1)))
    return sums.join(F.broadcast(whole)).select(F.col("i").alias("zone_id"), g.alias("gi_star"))


def value_ranks(df: DataFrame, by: str, value: str, buckets: int = 256) -> DataFrame:
    """by, value, m (rows), below (rows of the group with a lesser value), n (rows of the group).

    Values are counted first, then cut into ranges: sums over ranges give each range's start, and a window
    sorts the distinct values of one range of one group only, so no task holds a whole group.
    """
    counted = df.groupBy(by, value).agg(F.count("*").alias("m"))
    ends = counted.groupBy(by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum("m").alias("n"))
    place = (F.col(value) - F.col("__lo")) / F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo"))
    cut = counted.join(ends, by).withColumn("__b", F.coalesce(F.least(F.lit(buckets - 1), F.floor(place * buckets)), F.lit(0)).cast("int"))
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(by, "__b").agg(F.sum("m").alias("__m")).select(by, "__b", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__start") + F.coalesce(F.sum("m").over(inside), F.lit(0))
    return cut.join(starts, [by, "__b"]).select(by, value, "m", below.alias("below"), "n")


def ranked(df: DataFrame, by: str, value: str) -> DataFrame:
    """df with rank (ties share their average) and n of the group; rows without a value have neither."""
    r = value_ranks(df.where(F.col(value).isNotNull()), by, value)
    return df.join(r.select(by, value, (F.col("below") + (F.col("m") + 1) / 2).alias("rank"), "n"), [by, value], "left")


def gini(df: DataFrame, by: str, value: str) -> DataFrame:
    """Gini coefficient of each group, from counted values: equal ones take the ranks below + 1 .. below + m."""
    r = value_ranks(df, by, value)
    ranks = F.col("m") * F.col("below") + F.col("m") * (F.col("m") + 1) / 2
    s = r.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("m") * F.col(value)).alias("s"), F.sum(ranks * F.col(value)).alias("rs"))
    return s.select(by, "n", (2 * F.col("rs") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def simple_ols(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and r2 of y on x, by group: one pass of sums."""
    slope = F.covar_pop(x, y) / F.var_pop(x)
    return df.groupBy(*by).agg(F.count("*").alias("n"), slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"), (F.pow(F.corr(x, y), 2)).alias("r2"))


def spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Rank correlation of each group, ties by average rank. Values are counted first, so that a window sorts
    the distinct values of a group, not its rows."""

    def ranks(c: str, name: str) -> DataFrame:
        w = Window.partitionBy(by).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        n = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by, c).agg(F.count("*").alias("m"))
        return n.select(by, c, (F.sum("m").over(w) - (F.col("m") - 1) / 2).alias(name))

    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by, x, y).agg(F.count("*").alias("m"))
    r = pairs.join(ranks(x, "rx"), [by, x]).join(ranks(y, "ry"), [by, y])
    m, a, b = F.col("m"), F.col("rx"), F.col("ry")
    s = r.groupBy(by).agg(F.sum("m").alias("n"), *[F.sum(m * v).alias(k) for k, v in (("a", a), ("b", b), ("ab", a * b), ("aa", a * a), ("bb", b * b))])
    return s.selectExpr(by, "n", "(n * ab - a * b) / (sqrt(n * aa - a * a) * sqrt(n * bb - b * b)) AS rho")


def two_regressors(df: DataFrame, by: str, x1: str, x2: str, y: str) -> DataFrame:
    """Coefficients b0, b1, b2 of y on two columns by group, from one pass of moments."""
    m = df.groupBy(by).agg(
        F.count("*").alias("n"), F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"), F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"),
        F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"),
    )
    b = m.selectExpr("*", "(s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1", "(s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2")
    return b.selectExpr(by, "n", "my - b1 * m1 - b2 * m2 AS b0", "b1", "b2")
