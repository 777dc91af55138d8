"""Voronoi cells by half-plane clipping, each from its nearest seeds only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions import geometry
from terralith.operators import spatial_join
from terralith.operators.graph import cut


def _clipped(found: DataFrame, mask: Column) -> DataFrame:
    """x, y, ring, reach (the farthest seed met) of cells clipped by the seeds found for each place, nearest first."""
    seed = F.struct("rank", F.col("r_x").alias("x"), F.col("r_y").alias("y"), "d2")
    listed = spatial_join.spread(found, "x", "y").groupBy("x", "y").agg(F.array_sort(F.collect_list(seed)).alias("seeds"))

    def side(q):
        # left of the bisector is nearer to the cell's own seed
        mx, my = (F.col("x") + q["x"]) / 2, (F.col("y") + q["y"]) / 2
        a = F.struct(mx.alias("x"), my.alias("y"))
        return F.struct(a.alias("a"), F.struct((mx - (q["y"] - F.col("y"))).alias("x"), (my + (q["x"] - F.col("x"))).alias("y")).alias("b"))

    others = F.filter("seeds", lambda q: q["d2"] > 0)
    ring = geometry.left_of(mask, F.transform(others, side))
    return listed.select("x", "y", ring.alias("ring"), F.sqrt(F.element_at("seeds", -1)["d2"]).alias("reach"), F.size("seeds").alias("met"))


def voronoi(seeds: DataFrame, key: str, mask: Column, k: int = 16) -> DataFrame:
    """key, x, y, ring: the part of a convex counterclockwise mask nearer to each seed (x, y) than to any other.

    A cell is final once no seed beyond those met can cut it: they are at least twice as far as its farthest corner.
    Cells that aren't look at four times as many seeds. Seeds at equal places have equal cells, so a place is one seed.
    """
    places = cut(seeds.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min(key).alias(key)))
    total = places.count()
    done, todo = None, places.select("x", "y")
    while True:
        found = cut(_clipped(spatial_join.nearest(todo, places, key, key, k), mask))
        corner = F.array_max(F.transform("ring", lambda p: F.pow(p["x"] - F.col("x"), F.lit(2)) + F.pow(p["y"] - F.col("y"), F.lit(2))))
        final = (F.col("met") >= total) | (F.size("ring") == 0) | (F.col("reach") >= 2 * F.sqrt(corner))
        ready = found.where(final).select("x", "y", "ring")
        done = ready if done is None else done.unionByName(ready)
        todo = cut(found.where(~final).select("x", "y"))
        if todo.isEmpty():
            return seeds.select(key, "x", "y").join(done, ["x", "y"])
        k *= 4
