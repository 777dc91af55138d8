"""Raster operators on cell tables (row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions import geometry
from terralith.operators import arrangement, graph


def neighbours(cells: DataFrame, reach: int = 1) -> DataFrame:
    """row, col, dr, dc, value: each cell's value sent to the cells around it. One shuffle by target cell
    then gathers a neighbourhood, whatever the raster's size."""
    span = F.array(*[F.lit(k) for k in range(-reach, reach + 1)])
    return cells.select("row", "col", "value", F.explode(span).alias("dr")).select("*", F.explode(span).alias("dc")).select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), "dr", "dc", "value")


def focal_mean(cells: DataFrame, reach: int = 1) -> DataFrame:
    """Mean of the cells of the square around each cell that exist and hold a value."""
    around = neighbours(cells, reach).groupBy("row", "col").agg(F.avg("value").alias("focal_mean"), F.count("value").alias("n_cells"))
    return around.join(cells.select("row", "col"), ["row", "col"])


def slope(cells: DataFrame, size: float) -> DataFrame:
    """Horn's gradient of cells with all eight neighbours: gx, gy and slope in percent."""
    weight = lambda a, b: F.sum(F.when((F.col("dr") != 0) | (F.col("dc") != 0), F.col(a) * F.when(F.col(b) == 0, 2).otherwise(1) * F.col("value")).otherwise(0.0)) / (8 * size)
    g = neighbours(cells).groupBy("row", "col").agg(F.count("value").alias("n"), weight("dc", "dr").alias("gx"), weight("dr", "dc").alias("gy")).where("n = 9")
    return g.select("row", "col", "gx", "gy", (100 * F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("slope_pct"))


def reclass(value: Column, breaks: list[float]) -> Column:
    """1 for values under the first break, and so on; null stays null."""
    out = F.lit(len(breaks) + 1)
    for k, b in reversed(list(enumerate(breaks, 1))):
        out = F.when(value < b, k).otherwise(out)
    return F.when(value.isNotNull(), out)


def zonal(cells: DataFrame, zone: Column) -> DataFrame:
    """Count, sum, mean, extremes and population deviation of the cells of each zone, without those of none."""
    v = F.col("value")
    z = cells.withColumn("zone_id", zone).where("zone_id IS NOT NULL").groupBy("zone_id")
    return z.agg(F.count(v).alias("n_cells"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v).alias("spread"))


def block_mean(cells: DataFrame, factor: int) -> DataFrame:
    """Downsampled by an integer factor: mean of the cells that hold a value."""
    return cells.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg("value").alias("value"), F.count("value").alias("n_cells"))


def patches(cells: DataFrame, columns: int) -> DataFrame:
    """cells with patch: the least cell number of its 4-connected region."""
    c = cells.withColumn("node", F.col("row").cast("long") * columns + F.col("col"))
    step = F.array(F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit(1).alias("r"), F.lit(0).alias("c")))
    ahead = c.select(F.col("node").alias("a"), "row", "col", F.explode(step).alias("s")).select("a", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    linked = graph.components(ahead.join(c.select("row", "col", F.col("node").alias("b")), ["row", "col"]).select("a", "b"))
    return c.join(linked, "node", "left").withColumn("patch", F.coalesce("component", "node")).drop("component", "node")


def differences(cells: DataFrame) -> DataFrame:
    """row, col, value with those of the four cells beside it, for cells that have all four; one shuffle."""
    step = {"west": (0, -1), "east": (0, 1), "south": (1, 0), "north": (-1, 0)}
    at = lambda dr, dc: F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("value")))
    around = neighbours(cells).groupBy("row", "col").agg(at(0, 0).alias("value"), *[at(*s).alias(n) for n, s in step.items()])
    return around.dropna()


def slope_aspect(gx: Column, gy: Column) -> tuple[Column, Column]:
    """Slope, and the direction it falls to, clockwise from north; both in radians."""
    return F.atan(F.sqrt(gx * gx + gy * gy)), F.atan2(-gx, -gy)


def hillshade(slope_: Column, aspect: Column, azimuth: float, altitude: float) -> Column:
    """0..255: light from an azimuth (clockwise from north) at an altitude, both in degrees."""
    sun, high = F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    return 255 * F.greatest(F.lit(0.0), F.sin(high) * F.cos(slope_) + F.cos(high) * F.sin(slope_) * F.cos(sun - aspect))


def normalised_difference(a: Column, b: Column) -> Column:
    return (a - b) / F.when(a + b != 0, a + b)


def align_average(cells: DataFrame, size: int, target: int) -> DataFrame:
    """row, col, value, weight on a grid of another cell size with the same corner, weighted by shared area."""
    out = cells
    for c in ("row", "col"):
        span = F.sequence(F.floor(F.col(c) * size / target).cast("int"), F.ceil((F.col(c) + 1) * size / target).cast("int") - 1)
        out = out.withColumn(f"t_{c}", F.explode(span))
        shared = F.least((F.col(c) + 1) * size, (F.col(f"t_{c}") + 1) * target) - F.greatest(F.col(c) * size, F.col(f"t_{c}") * target)
        out = out.withColumn(f"w_{c}", shared)
    w = F.col("w_row") * F.col("w_col")
    return out.groupBy(F.col("t_row").alias("row"), F.col("t_col").alias("col")).agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"), F.sum(w).alias("weight"))


def align_bilinear(cells: DataFrame, factor: float, rows: int, columns: int) -> DataFrame:
    """Values at the centres of cells factor times as wide, from the source cells around each."""
    out = cells
    for c, n in (("row", rows), ("col", columns)):
        first = F.ceil((F.col(c) - 0.5) / factor - 0.5).cast("int")
        last = F.floor((F.col(c) + 1.5) / factor - 0.5).cast("int")
        out = out.withColumn(f"t_{c}", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(last, F.lit(0)))))
        out = out.where(F.col(f"t_{c}") < n)
        out = out.withColumn(f"w_{c}", 1 - F.abs(F.col(c) - (factor * (F.col(f"t_{c}") + 0.5) - 0.5)))
    w = F.col("w_row") * F.col("w_col")
    near = out.where("w_row > 0 AND w_col > 0").groupBy(F.col("t_row").alias("row"), F.col("t_col").alias("col"))
    return near.agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"))


def outline_edges(cells: DataFrame, region: str) -> DataFrame:
    """The sides of cells (region, r, c, across) that lie between a region and anything else."""
    side = lambda r, c, across: F.struct((F.col("row") + r).alias("r"), (F.col("col") + c).alias("c"), F.lit(across).alias("across"))
    sides = F.array(side(0, 0, True), side(1, 0, True), side(0, 0, False), side(0, 1, False))
    each = cells.select(region, F.explode(sides).alias("s")).groupBy(region, "s").agg(F.count("*").alias("m"))
    return each.where("m = 1").select(region, "s.*")


def region_edges(cells: DataFrame, region: str) -> DataFrame:
    """g (the region), x0, y0, x1, y1: sides of cells between a region and anything else, the region on their left;
    x counts columns, y rows upwards from the top edge."""
    corner = lambda dx, dy: ((F.col("col") + dx).cast("long"), (dy - F.col("row")).cast("long"))
    walk = [corner(0, -1), corner(1, -1), corner(1, 0), corner(0, 0)]
    side = lambda a, b, flip: F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"), F.lit(flip).alias("flip"))
    # a side shared by two cells is named the same way by both
    sides = F.array(*[side(*((a, b) if k < 2 else (b, a)), k >= 2) for k, (a, b) in enumerate(zip(walk, walk[1:] + walk[:1], strict=True))])
    each = cells.select(F.col(region).alias("g"), F.explode(sides).alias("s"))
    edges = each.groupBy("g", "s.x0", "s.y0", "s.x1", "s.y1").agg(F.count("*").alias("m"), F.max("s.flip").alias("flip")).where("m = 1")
    ends = [F.when(F.col("flip"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))]
    return edges.select("g", *ends)


def regions(cells: DataFrame, region: str, size: float) -> DataFrame:
    """region, shell, holes (vertices in metres from the upper left corner) of all regions of cells."""
    found = arrangement.rings(region_edges(cells, region), size)
    return arrangement.assembled(found.withColumn("ring", arrangement.straightened(F.col("ring"))), size).withColumnRenamed("g", region)


def burned(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """key, row, col of the cells of a grid whose centres lie in polygons (shell, holes)."""
    xs, ys = F.transform("shell", lambda p: p["x"]), F.transform("shell", lambda p: p["y"])
    span = lambda low, high: F.sequence(F.floor(low / size).cast("long"), F.ceil(high / size).cast("long"))
    at = polygons.select(key, "shell", "holes", F.explode(span(F.array_min(xs), F.array_max(xs))).alias("col"), ys.alias("ys"))
    at = at.select(key, "shell", "holes", "col", F.explode(span(-F.array_max("ys"), -F.array_min("ys"))).alias("row"))
    x, y = (F.col("col") + 0.5) * size, -(F.col("row") + 0.5) * size
    inside = geometry.contains(F.col("shell"), x, y) & ~F.exists("holes", lambda h: geometry.contains(h, x, y))
    return at.where(inside).select(key, "row", "col")


def window(cells: DataFrame, row: int, col: int, rows: int, columns: int, left: float, top: float, size: float) -> DataFrame:
    """The cells of a window, numbered from its own corner, with the corner of each cell."""
    inside = F.col("row").between(row, row + rows - 1) & F.col("col").between(col, col + columns - 1)
    x, y = F.lit(left) + F.col("col") * size, F.lit(top) - F.col("row") * size
    return cells.where(inside).select((F.col("row") - row).alias("row"), (F.col("col") - col).alias("col"), "value", x.alias("left_x"), y.alias("top_y"))


def cascade(cells: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """step, rule, remaining, lost: cells that pass all rules so far, and those that failed this one first."""
    passed = lambda k: F.expr(" AND ".join(f"coalesce({t}, FALSE)" for _, t in rules[:k]) or "TRUE")
    counts = [F.struct(F.count_if(passed(k + 1)).alias("remaining"), F.count_if(passed(k) & ~passed(k + 1)).alias("lost")).alias(f"s{k}") for k in range(len(rules))]
    rows = [F.struct(F.lit(k).alias("step"), F.lit(name).alias("rule"), F.col(f"s{k}.remaining").alias("remaining"), F.col(f"s{k}.lost").alias("lost")) for k, (name, _) in enumerate(rules)]
    return cells.agg(*counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
