"""k-means for several k at once, silhouettes from cluster moments, fragmentation of clusters in space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.operators import graph


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with z_column: less the mean, by the population's deviation (0 where there is none)."""
    m = rows.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    z = lambda c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0).alias(f"z_{c}")
    return rows.join(F.broadcast(m)).select(*rows.columns, *[z(c) for c in columns])


def _nearest(columns: list[str], centres: list[tuple]) -> Column:
    """struct<d, c>: squared distance and number of the nearest centre, the lesser number of those equal to nine digits."""
    gaps = [F.struct(F.round(sum((F.pow(F.col(z) - F.lit(float(v)), F.lit(2)) for z, v in zip(columns, centre, strict=True)), F.lit(0.0)), 9).alias("d"), F.lit(c).alias("c")) for c, centre in enumerate(centres)]
    return F.array_min(F.array(*gaps))


def kmeans(rows: DataFrame, columns: list[str], ks: list[int], rounds: int = 12) -> dict[int, list[tuple]]:
    """Centres for each k by Lloyd's rounds: all k share one pass over the rows a round. The first centres are the
    middles of k equal parts of each column; a centre that loses all its rows stays where it was."""
    shares = {k: [(c + 0.5) / k for c in range(k)] for k in ks}
    first = rows.agg(*[F.percentile(z, F.array(*map(F.lit, shares[k]))).alias(f"{z}_{k}") for z in columns for k in ks]).first()
    if first[0] is None:
        return {k: [] for k in ks}
    centres = {k: list(zip(*(first[f"{z}_{k}"] for z in columns), strict=True)) for k in ks}
    for _ in range(rounds):
        picks = F.array(*[F.struct(F.lit(k).alias("k"), _nearest(columns, centres[k])["c"].alias("c")) for k in ks])
        means = rows.select(*columns, F.explode(picks).alias("at")).groupBy("at.k", "at.c").agg(*[F.avg(z).alias(z) for z in columns]).collect()
        for r in means:
            centres[r["k"]][r["c"]] = tuple(r[z] for z in columns)
    return centres


def labelled(rows: DataFrame, columns: list[str], centres: list[tuple]) -> DataFrame:
    """rows with cluster and d2 from its centre."""
    return rows.withColumn("__n", _nearest(columns, centres)).withColumn("cluster", F.col("__n.c")).withColumn("d2", F.col("__n.d")).drop("__n")


def sweep(rows: DataFrame, columns: list[str], centres: dict[int, list[tuple]]) -> DataFrame:
    """k, inertia, silhouette (squared distances) of each k. A row's mean squared distance to a cluster is that to its
    mean plus the cluster's variance, so no pairs are formed; rows alone in a cluster count 0."""
    square = lambda of: sum((F.pow(F.col(z) - of(z), F.lit(2)) for z in columns), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(k).alias("k"), _nearest(columns, c)["c"].alias("c")) for k, c in centres.items()])
    at = rows.select(*columns, F.explode(each).alias("at")).select(*columns, "at.*")
    moments = at.groupBy("k", "c").agg(F.count("*").alias("m"), *[F.avg(z).alias(f"mean_{z}") for z in columns], *[F.var_pop(z).alias(f"var_{z}") for z in columns])
    moments = moments.select("k", F.struct("c", "m", *[f"mean_{z}" for z in columns], sum((F.col(f"var_{z}") for z in columns), F.lit(0.0)).alias("var")).alias("s"))
    all_of = moments.groupBy("k").agg(F.collect_list("s").alias("clusters"))  # k rows at most
    far = lambda s: square(lambda z: s[f"mean_{z}"]) + s["var"]
    own = F.filter("clusters", lambda s: s["c"] == F.col("c"))[0]
    others = F.array_min(F.transform(F.filter("clusters", lambda s: s["c"] != F.col("c")), far))
    a = at.join(F.broadcast(all_of), "k").select("k", own.alias("own"), others.alias("b"), *columns)
    mean = far(F.col("own")) * F.col("own.m") / F.when(F.col("own.m") > 1, F.col("own.m") - 1)
    s = a.select("k", square(lambda z: F.col(f"own.mean_{z}")).alias("d2"), mean.alias("a"), "b")
    width = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.when(F.greatest("a", "b") > 0, F.greatest("a", "b")))
    return s.groupBy("k").agg(F.count("*").alias("n"), F.sum("d2").alias("inertia"), F.avg(F.coalesce(width, F.lit(0.0))).alias("silhouette"))


def fragments(rows: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """cluster, n, parts, largest: connected parts of each cluster under contiguity (edges a, b of keys)."""
    label = rows.select(F.col(key).alias("a"), F.col("cluster").alias("ca"))
    inside = edges.join(label, "a").join(label.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b").where("ca = cb").select("a", "b")
    parts = rows.select(key, "cluster").join(graph.components(inside).withColumnRenamed("node", key), key, "left").withColumn("part", F.coalesce("component", key))
    sizes = parts.groupBy("cluster", "part").agg(F.count("*").alias("m"))
    return sizes.groupBy("cluster").agg(F.sum("m").alias("n"), F.count("*").alias("parts"), F.max("m").alias("largest"))
