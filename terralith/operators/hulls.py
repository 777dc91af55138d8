"""Convex hulls of grouped points and thinned lines."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a group that are brought together before its last hull.
PARTS = 64


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counterclockwise from the leftmost lowest one; points on an edge are no corners."""
    xy = np.unique(xy, axis=0)
    if len(xy) > 64:
        # points well inside the octagon of the extremes can't be corners
        turns = np.arange(8) * (np.pi / 4)
        ends = xy[np.argmax(xy @ np.array([np.cos(turns), np.sin(turns)]), axis=0)]
        side = np.roll(ends, -1, axis=0) - ends
        left = side[:, 0] * (xy[:, 1:] - ends[:, 1]) - side[:, 1] * (xy[:, :1] - ends[:, 0])
        far = (side != 0).any(axis=1)
        xy = xy[~(left[:, far] > 1e-6 * np.abs(xy).max()).all(axis=1)]
    if len(xy) < 3:
        return xy

    def half(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    points = xy.tolist()
    return np.array(half(points) + half(points[::-1]))


def convex_hulls(points: DataFrame, by: str) -> DataFrame:
    """by, ring: the convex hull of each group's points (columns x and y).

    Each task reduces its rows to one hull a group before anything is shuffled; these meet in PARTS parts of a
    group and then as a whole, so no task reads a group's points. Points with a null coordinate take no part;
    a null group is a group; one or two different points give a ring of so many.
    """
    rows = points.where("x IS NOT NULL AND y IS NOT NULL").select(F.col(by), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kind = rows.schema[by].dataType.simpleString()

    def reduce_task(batches):
        held = {}
        for batch in batches:
            for key, g in batch.groupby(by, dropna=False):
                key = None if pd.isna(key) else key
                xy = g[["x", "y"]].to_numpy()
                held[key] = hull(np.concatenate([held[key], xy]) if key in held else xy)
        for key, xy in held.items():
            yield pd.DataFrame({by: pd.Series([key] * len(xy), dtype=object), "x": xy[:, 0], "y": xy[:, 1]})

    def again(g):
        xy = hull(g[["x", "y"]].to_numpy())
        return pd.DataFrame({by: pd.Series([g[by].iloc[0]] * len(xy), dtype=object), "x": xy[:, 0], "y": xy[:, 1]})

    def whole(g):
        xy = hull(g[["x", "y"]].to_numpy())
        return pd.DataFrame({by: pd.Series([g[by].iloc[0]], dtype=object), "ring": [[{"x": x, "y": y} for x, y in xy.tolist()]]})

    flat = f"`{by}` {kind}, x double, y double"
    parts = rows.mapInPandas(reduce_task, flat).withColumn("part", F.spark_partition_id() % PARTS)
    parts = parts.groupBy(by, "part").applyInPandas(again, flat)
    return parts.groupBy(by).applyInPandas(whole, f"`{by}` {kind}, ring array<struct<x:double,y:double>>")


def kept_vertices(line: np.ndarray, tolerance: float) -> list[int]:
    """Douglas-Peucker: places of the vertices kept, the first of equally far ones."""
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        way, off = line[j] - line[i], line[i + 1 : j] - line[i]
        # a closed stretch has no direction: its vertices are measured from its end
        far = np.abs(way[0] * off[:, 1] - way[1] * off[:, 0]) if way.any() else np.hypot(*off.T)
        m = int(far.argmax())
        if far[m] > tolerance * (np.hypot(*way) if way.any() else 1):
            keep.add(i + 1 + m)
            todo += [(i, i + 1 + m), (i + 1 + m, j)]
    return sorted(keep)


def simplify(line: Column, tolerance: float) -> Column:
    """Places of the vertices of a line (array of struct<x, y>) that Douglas-Peucker keeps; null for null, empty for empty."""
    @F.pandas_udf("array<int>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        made = [None if x is None else kept_vertices(np.column_stack([x, y]).astype(float), tolerance) if len(x) else [] for x, y in zip(xs, ys, strict=True)]
        return pd.Series(made, dtype=object)

    return run(F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"]))


def simplified_ring(ring: Column, tolerance: float) -> Column:
    """A ring thinned by Douglas-Peucker as the closed line from its first vertex; fewer than three vertices stay as they were."""
    at = simplify(F.concat(ring, F.slice(ring, 1, 1)), tolerance)
    kept = lambda at: F.transform(F.filter(at, lambda i: i < F.size(ring)), lambda i: F.get(ring, i))
    return F.when(F.size(at) > 3, kept(at)).otherwise(ring)
