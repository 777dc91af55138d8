"""Spatial joins as equi-joins on grid cells with an exact residual test, planned as ordinary hash joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.graph import cut


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def cover(shapes: DataFrame, size: float) -> DataFrame:
    """A row for each grid cell that a shape's bounds (xmin .. ymax) touch: columns cx, cy."""
    return shapes.withColumn("cx", F.explode(F.sequence(cell(F.col("xmin"), size), cell(F.col("xmax"), size)))).withColumn("cy", F.explode(F.sequence(cell(F.col("ymin"), size), cell(F.col("ymax"), size))))


def with_cell(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))


def join_within(points: DataFrame, shapes: DataFrame, test: Column, size: float = 4000.0, how: str = "inner") -> DataFrame:
    """points (x, y) with the shapes for which test holds; a point meets a shape in one cell only."""
    return with_cell(points, size).join(cover(shapes, size), ["cx", "cy"]).where(test).drop("cx", "cy") if how == "inner" else with_cell(points, size).alias("p").join(cover(shapes, size).alias("s"), (F.col("p.cx") == F.col("s.cx")) & (F.col("p.cy") == F.col("s.cy")) & test, how)


def join_near(left: DataFrame, right: DataFrame, radius: float, tasks: int | None = None, fine: int = 1) -> DataFrame:
    """Pairs at most radius apart; right's columns get the prefix r_. A cell is the radius by fine wide, and the left row
    looks into its own and those around it that the circle may reach: fine cells suit circles with many rows. Cells are
    dealt over so many tasks, if given."""
    size, look = radius / fine, range(-fine, fine + 1)
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    r = r.withColumn("cx", cell(F.col("r_x"), size)).withColumn("cy", cell(F.col("r_y"), size))
    gap = lambda k: max(abs(k) - 1, 0)
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in look for j in look if gap(i) ** 2 + gap(j) ** 2 <= fine**2])
    near = with_cell(left, size).withColumn("step", F.explode(steps))
    near = near.withColumn("cx", F.col("cx") + F.col("step.dx")).withColumn("cy", F.col("cy") + F.col("step.dy")).drop("step")
    if tasks:
        near, r = near.repartition(tasks, "cx", "cy"), r.repartition(tasks, "cx", "cy")
    d2 = (F.col("x") - F.col("r_x")) * (F.col("x") - F.col("r_x")) + (F.col("y") - F.col("r_y")) * (F.col("y") - F.col("r_y"))
    return near.join(r, ["cx", "cy"]).drop("cx", "cy").withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, k: int = 1, radius: float = 1000.0, widest: float = 1e9) -> DataFrame:
    """The k nearest right rows of each left row (fewer if there are not so many), equal distances by right_key.

    Left rows at one place look once, and of right rows at one place the k least keys are enough. The first circle is
    one that holds a few times k rows on average, the given radius at most. Places that find fewer than k look again,
    four times as far; each round works on these only, in as many tasks as the rows of their circles need.
    """
    first = Window.partitionBy("x", "y").orderBy(right_key)
    right = cut(right.where("x IS NOT NULL AND y IS NOT NULL").withColumn("__place", F.row_number().over(first)).where(F.col("__place") <= k).drop("__place"))
    places = cut(left.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct())
    spread_ = right.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    extent = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if spread_[0] is None or extent[0] is None:
        return join_near(left, right, radius).withColumn("rank", F.lit(1))
    widest = min(widest, 1 + ((max(spread_[1], extent[1]) - min(spread_[0], extent[0])) ** 2 + (max(spread_[3], extent[3]) - min(spread_[2], extent[2])) ** 2) ** 0.5)
    space = (spread_[1] - spread_[0]) * (spread_[3] - spread_[2])
    dense = (4 * k * space / (3.14159 * spread_[4])) ** 0.5
    radius = min(radius, dense) if dense > 0 else radius

    def tasks(n, radius):
        # a place is few bytes that stand for nine looks and all rows of its circle: a task for a quarter of a million rows
        circle = spread_[4] * min(1.0, 3.14159 * radius**2 / space) if space > 0 else spread_[4]
        return min(1 + int((n * (9 + circle) + spread_[4]) / 250_000), 32 * places.sparkSession.sparkContext.defaultParallelism)

    done, todo, n_todo, dealt = None, places, extent[4], False
    order = Window.partitionBy("x", "y").orderBy("d2", f"r_{right_key}")
    while True:
        wanted = tasks(n_todo, min(radius, widest))
        dealt = dealt or wanted > 1  # searches that one task can do need no dealing
        found = join_near(todo, right, min(radius, widest), *([wanted] if dealt else [])).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if radius >= widest:
            done = found if done is None else done.unionByName(found)
            break
        # the next rounds start from these rows, not from the input
        found = cut(found.withColumn("found", F.count("*").over(Window.partitionBy("x", "y"))))
        full = found.where(F.col("found") == k).drop("found")
        done = full if done is None else done.unionByName(full)
        todo = cut(todo.join(full.where("rank = 1").select("x", "y"), ["x", "y"], "left_anti"))
        n_todo = todo.count()
        if n_todo == 0:
            break
        radius *= 4
    return left.join(done, ["x", "y"])


def pairs(left: DataFrame, right: DataFrame, size: float = 1000.0, margin: float = 0.0) -> DataFrame:
    """left and right (columns prefixed r_) whose bounds, margin apart at most, share a point; each pair once.

    Shapes meet in the grid cells that both bounds cover; the cell of the greater lower corners counts.
    """
    low, high = [f"{c}min" for c in "xy"], [f"{c}max" for c in "xy"]
    wide = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    for c in "xy":
        wide = wide.withColumn(f"w_{c}min", F.col(f"r_{c}min") - margin).withColumn(f"w_{c}max", F.col(f"r_{c}max") + margin)
        span = F.sequence(cell(F.col(f"w_{c}min"), size), cell(F.col(f"w_{c}max"), size))
        wide = wide.withColumn(f"c{c}", F.explode(span))
    met = cover(left, size).join(wide, ["cx", "cy"])
    for c, lo, hi in zip("xy", low, high, strict=True):
        met = met.where((F.col(lo) <= F.col(f"w_{hi}")) & (F.col(hi) >= F.col(f"w_{lo}")))
        met = met.where(F.col(f"c{c}") == cell(F.greatest(F.col(lo), F.col(f"w_{lo}")), size))
    return met.drop("cx", "cy", *[f"w_{c}" for c in low + high])


def with_matches(left: DataFrame, found: DataFrame, key: str, how: str) -> DataFrame:
    """left with its rows of found (which hold key): inner, left (unmatched rows stay), semi or anti."""
    if how in ("semi", "anti"):
        return left.join(found.select(key).distinct(), key, f"left_{how}")
    return left.join(found, key, how)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over all cores, those of equal keys together: few bytes that stand for much work would otherwise be put
    into one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def once(layer: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that agree in columns as one row: columns, key (the least of theirs) and m, their number. Pairs of such rows
    stand for all pairs of copies, so a layer with many copies is searched once."""
    return layer.groupBy(*columns).agg(F.min(key).alias(key), F.count("*").alias("m"))


def valued(pairs_: DataFrame, xs: list[str], ys: list[str], values, also: list[str] | None = None) -> DataFrame:
    """pairs_ with the columns that values adds to a DataFrame of their coordinates xs, ys (the first ones are the origin) and
    of the columns also, which a move leaves as they are.

    values must not change when a pair is moved: it is worked out once for all pairs that a move carries onto each
    other. Pairs whose coordinates such a move would round stay where they are.
    """
    exact = F.lit(True)
    for names in (xs, ys):
        o = F.col(names[0])
        for c in names[1:]:
            exact = exact & (F.col(c) - (F.col(c) - o) == o) & ((F.col(c) - o) + o == F.col(c))
    moved = {f"__{c}": F.when(exact, F.col(c) - F.col(names[0])).otherwise(F.col(c)) for names in (xs, ys) for c in names}
    at = cut(pairs_.withColumns(moved))
    also = also or []
    kinds = spread(at.select(*moved, *also).distinct()).withColumnsRenamed({f"__{c}": c for c in xs + ys})
    kinds = cut(values(kinds)).withColumnsRenamed({c: f"__{c}" for c in xs + ys})
    return at.join(kinds, [*moved, *also]).drop(*moved)


def contract(left: DataFrame, found: DataFrame, key: str | list[str], times: str | None = None) -> DataFrame:
    """One row on the cardinality of a join: rows in, rows out, unmatched, matched once, matched more often. A row of
    found stands for as many as its column times says."""
    key = [key] if isinstance(key, str) else key
    n = left.select(*key).join(found.groupBy(*key).agg((F.sum(times) if times else F.count("*")).alias("n")), key, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    one = [F.count_if(F.col("n") == 0).alias("unmatched"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("several")]
    return n.agg(F.count("*").alias("rows_in"), F.sum("n").alias("rows_out"), *one, F.max("n").alias("most"))
