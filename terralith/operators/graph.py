"""Graphs as edge tables: components and shortest paths in rounds of joins, each round cut from the last."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of spark.checkpoint.dir; a local one only where the session names none."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-terralith-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node with an edge (a, b).

    In a round a node takes the least label around it, and so does the node that its label names: whole trees hook
    onto smaller ones at once. Labels then jump to their own labels, so that long chains take few rounds.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        seen = cut(labels.join(near, "a"))
        roots = seen.groupBy(F.col("c").alias("a")).agg(F.min("m").alias("h"))
        hooked = cut(seen.join(roots, "a", "left").select("a", F.least("c", "m", "h").alias("c"), F.col("c").alias("before")))
        up = hooked.select(F.col("a").alias("k"), F.col("c").alias("up"))
        step = cut(hooked.join(up, F.col("c") == F.col("k")).select("a", F.col("up").alias("c"), (F.col("up") != F.col("before")).alias("moved")))
        labels = step.select("a", "c")
        if step.where("moved").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("c").alias("component"))


def shortest_paths(edges: DataFrame, sources: DataFrame, legs: int | None = None) -> DataFrame:
    """node, distance from the nearest source over edges (a, b, w >= 0), by at most so many legs (None: any).

    Only nodes that came nearer in the last round are followed in the next.
    """
    best = cut(sources.select("node", F.lit(0.0).alias("distance")).distinct())
    front, done = best, 0
    while (legs is None or done < legs) and not front.isEmpty():
        met = front.join(edges, F.col("node") == F.col("a")).groupBy("b").agg(F.min(F.col("distance") + F.col("w")).alias("via")).withColumnRenamed("b", "node")
        step = cut(best.join(met, "node", "full").select("node", F.least("distance", "via").alias("distance"), F.expr("via < coalesce(distance, double('inf'))").alias("nearer")))
        best, front, done = step.select("node", "distance"), step.where("nearer").select("node", "distance"), done + 1
    return best
