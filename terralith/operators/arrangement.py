"""Arrangements of segments as joins: noding, sides of pieces, boolean combinations, chains and rings.

Segments are rows g, p, sid, ax, ay, bx, by: sid names a segment within its group g, and only segments of one group
meet. Nodes lie on a grid, so that pieces found by different tasks end at equal integers. Pairs meet in grid cells;
a piece is located by a ray through one strip of its group; chains and rings are ranked by pointer doubling, in a
number of rounds that grows with the logarithm of the longest.

Defined results: segments shorter than the grid vanish; equal segments of one polygon cancel in pairs (even-odd rule);
null coordinates meet nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions.geometry import segment_distance2
from terralith.operators.graph import cut
from terralith.operators.spatial_join import cell, cover

GRID = 1e-5
_ENDS = ("ax", "ay", "bx", "by")
_EDGE = ("x0", "y0", "x1", "y1")


def boundary(polygons: DataFrame, key: str, parts: str, group: Column | None = None) -> DataFrame:
    """Segments of every ring of polygons (arrays of struct<shell, holes>): g (the key unless given), p, sid, ends."""
    rings = F.flatten(F.transform(parts, lambda s: F.concat(F.array(s["shell"]), s["holes"])))
    each = polygons.select((group if group is not None else F.col(key)).alias("g"), F.col(key).alias("p"), F.posexplode(rings).alias("r", "ring"))
    each = each.select("g", "p", "r", "ring", F.posexplode("ring").alias("i", "a"))
    b = F.coalesce(F.get("ring", F.col("i") + 1), F.get("ring", F.lit(0)))
    sid = F.concat_ws("/", "p", "r", "i")
    return each.select("g", "p", sid.alias("sid"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def _bounded(segments: DataFrame, margin: float) -> DataFrame:
    ends = [((f"{c}min", F.least), (f"{c}max", F.greatest)) for c in "xy"]
    return segments.select("*", *[(f(f"a{n[0]}", f"b{n[0]}") + (margin if n.endswith("max") else -margin)).alias(n) for pair in ends for n, f in pair])


def noded(segments: DataFrame, size: float = 500.0, grid: float = GRID) -> DataFrame:
    """Pieces g, p, sid, x0, y0, x1, y1 (grid units): every segment cut wherever another of its group crosses or
    touches it. Long segments lie in several cells; a pair counts in the cell of its greater lower corners."""
    s = _bounded(segments, grid)
    other = s.select(F.col("g"), *[F.col(c).alias(f"o_{c}") for c in s.columns if c != "g"])
    spans = {c: F.sequence(cell(F.col(f"o_{c}min"), size), cell(F.col(f"o_{c}max"), size)) for c in "xy"}
    other = other.withColumn("cx", F.explode(spans["x"])).withColumn("cy", F.explode(spans["y"]))
    met = cover(s, size).join(other, ["g", "cx", "cy"]).where("sid < o_sid AND xmin <= o_xmax AND xmax >= o_xmin AND ymin <= o_ymax AND ymax >= o_ymin")
    for c in "xy":
        met = met.where(F.col(f"c{c}") == cell(F.greatest(F.col(f"{c}min"), F.col(f"o_{c}min")), size))
    own, far = [F.col(c) for c in _ENDS], [F.col(f"o_{c}") for c in _ENDS]
    near = lambda x, y, line: segment_distance2(x, y, *line) <= grid * grid
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ends = [(far[0], far[1], own), (far[2], far[3], own), (own[0], own[1], far), (own[2], own[3], far)]
    touching = F.filter(F.array(*[F.when(near(x, y, line), point(x, y)) for x, y, line in ends]), lambda q: q.isNotNull())
    turn = lambda line, x, y: (line[2] - line[0]) * (y - line[1]) - (line[3] - line[1]) * (x - line[0])
    start, end = turn(far, own[0], own[1]), turn(far, own[2], own[3])
    crossed = (start * end < 0) & (turn(own, far[0], far[1]) * turn(own, far[2], far[3]) < 0)
    share = start / F.when(start != end, start - end)
    crossing = F.array(point(own[0] + share * (own[2] - own[0]), own[1] + share * (own[3] - own[1])))
    met = met.withColumn("at", touching).withColumn("at", F.when(F.size("at") > 0, F.col("at")).when(crossed, crossing).otherwise(F.col("at")))
    names = ["p", "sid", *_ENDS]
    sides = F.array(F.struct(*names), F.struct(*[F.col(f"o_{c}").alias(c) for c in names]))
    hits = met.where("size(at) > 0").select("g", "at", F.explode(sides).alias("s")).select("g", "s.*", F.explode("at").alias("q"))
    every = hits.unionByName(segments.select("g", *names, F.explode(F.array(point(*own[:2]), point(*own[2:]))).alias("q")))
    snap = lambda c: F.round(F.col(f"q.{c}") / grid).cast("long").alias(c)
    nodes = every.select("g", *names, snap("x"), snap("y")).distinct()
    along = (F.col("x") * grid - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") * grid - F.col("ay")) * (F.col("by") - F.col("ay"))
    order = Window.partitionBy("g", "sid").orderBy("along", "x", "y")
    nodes = nodes.withColumn("along", along).withColumn("x1", F.lead("x").over(order)).withColumn("y1", F.lead("y").over(order))
    return nodes.where("x1 IS NOT NULL").select("g", "p", "sid", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def _undirected(pieces: DataFrame) -> DataFrame:
    swap = F.expr("struct(x1, y1) < struct(x0, y0)")
    turned = [F.when(swap, F.col(a)).otherwise(F.col(b)).alias(b) for b, a in zip(_EDGE, ("x1", "y1", "x0", "y0"), strict=True)]
    return pieces.select("g", "p", "sid", *turned)


def sides(segments: DataFrame, size: float = 500.0, grid: float = GRID) -> DataFrame:
    """Distinct pieces g, x0, y0, x1, y1 with the sorted lists of polygons to their left and right.

    A ray to the right from the middle of a piece counts the segments of each polygon that it crosses; those the
    piece lies on tell its two sides apart.
    """
    pieces = cut(_undirected(noded(segments, size, grid)))
    edges = pieces.groupBy("g", *_EDGE).agg(F.collect_list("sid").alias("own"))
    mid = edges.select("*", ((F.col("x0") + F.col("x1")) / 2 * grid).alias("mx"), ((F.col("y0") + F.col("y1")) / 2 * grid).alias("my")).withColumn("strip", cell(F.col("my"), size))
    upright = segments.where("ay <> by").withColumn("strip", F.explode(F.sequence(cell(F.least("ay", "by"), size), cell(F.greatest("ay", "by"), size))))
    beyond = F.expr("(ay > my) <> (by > my) AND ax + (my - ay) / (by - ay) * (bx - ax) > mx AND NOT array_contains(own, sid)")
    rays = mid.join(upright, ["g", "strip"]).where(beyond).select("g", *_EDGE, "p", F.lit(1).alias("c"), F.lit(0).alias("m"))
    counts = rays.unionByName(pieces.select("g", *_EDGE, "p", F.lit(0).alias("c"), F.lit(1).alias("m"))).groupBy("g", *_EDGE, "p").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))
    across, beside = F.col("c") % 2 == 1, (F.col("c") + F.col("m")) % 2 == 1
    rises = F.col("y1") > F.col("y0")
    left, right = F.when(rises, beside).otherwise(across), F.when(rises, across).otherwise(beside)
    listed = lambda side: F.array_sort(F.collect_set(F.when(side, F.col("p"))))
    return counts.groupBy("g", *_EDGE).agg(listed(left).alias("left"), listed(right).alias("right"))


def outline(edges: DataFrame, inside: Callable[[Column], Column], group: list[Column] | None = None) -> DataFrame:
    """Directed pieces with what inside(list of polygons) holds to their left, and nothing of it to their right."""
    held, beyond = inside(F.col("left")), inside(F.col("right"))
    ends = [F.when(held, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(_EDGE, ("x1", "y1", "x0", "y0"), strict=True)]
    return edges.where(held != beyond).select("g", *(group or []), *ends)


def under(x0: Column, y0: Column, x1: Column, y1: Column, grid: float = GRID) -> Column:
    """A directed piece's share of the area to its left."""
    return (x0 - x1) * grid * ((y0 + y1) * (grid / 2))


def area(grid: float = GRID) -> Column:
    """Aggregate: area within directed pieces."""
    return F.sum(under(*[F.col(c) for c in _EDGE], grid))


def chained(links: DataFrame) -> DataFrame:
    """e, chain, steps, closed of linked items (e, next; next null at a chain's end): the chain is named by its last
    item, a cycle by its least, and steps lead from an item to it. Pointers double each round."""
    now = cut(links.select("e", F.col("next").alias("jump"), F.col("e").alias("least"), F.lit(0).cast("long").alias("to_least"), F.col("e").alias("last"), F.lit(0).cast("long").alias("to_last"), F.lit(1).cast("long").alias("far"), F.lit(True).alias("moved")))
    ended = -1
    while True:
        state = now.agg(F.count_if("moved").alias("moved"), F.count_if(F.col("jump").isNull()).alias("ended")).first()
        if not state["moved"] and state["ended"] == ended:
            break
        ended = state["ended"]
        ahead = now.select(F.col("e").alias("jump"), *[F.col(c).alias(f"n_{c}") for c in ("jump", "least", "to_least", "last", "to_last", "far")])
        met = now.drop("moved").join(ahead, "jump", "left")
        on, less = F.col("n_last").isNotNull(), F.col("n_least") < F.col("least")
        pick = lambda test, new, old, name: F.when(test, new).otherwise(F.col(old)).alias(name)
        now = cut(met.select(
            "e", F.col("n_jump").alias("jump"), pick(less, F.col("n_least"), "least", "least"), pick(less, F.col("far") + F.col("n_to_least"), "to_least", "to_least"),
            pick(on, F.col("n_last"), "last", "last"), pick(on, F.col("far") + F.col("n_to_last"), "to_last", "to_last"), pick(on, F.col("far") + F.col("n_far"), "far", "far"), F.coalesce(less, F.lit(False)).alias("moved"),
        ))
    closed = F.col("jump").isNotNull()
    return now.select("e", F.when(closed, F.col("least")).otherwise(F.col("last")).alias("chain"), F.when(closed, F.col("to_least")).otherwise(F.col("to_last")).alias("steps"), closed.alias("closed"))


def rings(directed: DataFrame, grid: float = GRID) -> DataFrame:
    """g, ring, area of the closed walks along directed pieces (inside on the left): at a node the walk takes the
    first piece clockwise from where it came, so rings that touch stay apart. Holes have negative areas."""
    item = F.struct("g", *_EDGE)
    angle = lambda dx, dy: F.atan2(dy.cast("double"), dx.cast("double"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    none = F.lit(None).cast(directed.select(item.alias("e")).schema["e"].dataType)
    leaving = directed.select("g", F.col("x0").alias("x"), F.col("y0").alias("y"), angle(dx, dy).alias("at"), item.alias("leaves"), none.alias("comes"))
    coming = directed.select("g", F.col("x1").alias("x"), F.col("y1").alias("y"), angle(-dx, -dy).alias("at"), none.alias("leaves"), item.alias("comes"))
    by = Window.partitionBy("g", "x", "y").orderBy(F.col("at").desc())
    later = F.first("leaves", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    around = F.first("leaves", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    links = leaving.unionByName(coming).select("comes", F.coalesce(later, around).alias("next")).where("comes IS NOT NULL")
    walk = chained(links.select(F.col("comes").alias("e"), "next"))
    vertex = F.struct((-F.col("steps")).alias("k"), (F.col("e.x0") * grid).alias("x"), (F.col("e.y0") * grid).alias("y"))
    sized = F.sum(under(*[F.col(f"e.{c}") for c in _EDGE], grid))
    closed = walk.groupBy(F.col("e.g").alias("g"), "chain").agg(F.array_sort(F.collect_list(vertex)).alias("v"), sized.alias("area"))
    return closed.select("g", F.transform("v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("ring"), "area")


def straightened(ring: Column) -> Column:
    """A ring without the vertices at which it goes straight on."""
    n = F.size(ring)
    at = lambda r, i: F.get(r, F.pmod(i, n))

    def turns(p, i):
        a, b = at(ring, i - 1), at(ring, i + 1)
        return F.abs((p["x"] - a["x"]) * (b["y"] - p["y"]) - (p["y"] - a["y"]) * (b["x"] - p["x"])) > 1e-9 * (F.abs(b["x"] - a["x"]) + F.abs(b["y"] - a["y"]) + 1)

    return F.filter(ring, turns)


def assembled(found: DataFrame, grid: float = GRID) -> DataFrame:
    """g, shell, holes of rings (g, ring, area): a hole belongs to the smallest shell of its group around it."""
    from terralith.functions import geometry

    shells = found.where("area > 0").select("g", F.col("ring").alias("shell"), F.col("area").alias("size"))
    holes = found.where("area < 0").select("g", F.col("ring").alias("hole"))
    # the lowest leftmost vertex of a hole may lie on its shell: its first edge's middle, a little inside the hole, doesn't
    a, b = F.col("hole")[0], F.col("hole")[1]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    long = F.sqrt(dx * dx + dy * dy)
    x, y = (a["x"] + b["x"]) / 2 + dy / long * grid / 4, (a["y"] + b["y"]) / 2 - dx / long * grid / 4
    met = holes.select("g", "hole", x.alias("hx"), y.alias("hy")).join(shells, "g").where(geometry.contains(F.col("shell"), F.col("hx"), F.col("hy")))
    owned = met.groupBy("g", "hole").agg(F.min_by("shell", "size").alias("shell")).groupBy("g", "shell").agg(F.collect_list("hole").alias("holes"))
    return shells.join(owned, ["g", "shell"], "left").select("g", "shell", F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>")).alias("holes"), "size")


def even_odd(rings_: DataFrame, key: str, size: float = 500.0, grid: float = GRID) -> DataFrame:
    """key, shell, holes of polygons whose rings (column rings: arrays of vertices) may cross or overlap in any way: what
    an odd number of turns surrounds is inside."""
    parts = F.transform("rings", lambda r: F.struct(r.alias("shell"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes")))
    edges = sides(boundary(rings_.withColumn("__parts", parts), key, "__parts"), size, grid)
    walked = rings(outline(edges, lambda held: F.size(held) > 0), grid)
    return assembled(walked, grid).withColumnRenamed("g", key)


def merged_lines(pieces: DataFrame) -> DataFrame:
    """g, line, closed: pieces (g, x0 .. y1; each once, in any direction) joined into lines through all nodes where
    just two of them end; loops without any other node are closed."""
    node = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    both = pieces.select("g", node("x0", "y0").alias("u"), node("x1", "y1").alias("v"))
    arcs = both.unionByName(both.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
    ways = arcs.groupBy("g", "u").agg(F.count("*").alias("m"), F.min("v").alias("one"), F.max("v").alias("two")).where("m = 2").select("g", F.col("u").alias("v"), "one", "two")
    on = arcs.join(ways, ["g", "v"], "left")
    beyond = F.when(F.col("one") == F.col("u"), F.col("two")).otherwise(F.col("one"))
    item = F.struct("g", "u", "v")
    links = on.select(item.alias("e"), F.when(F.col("one").isNotNull(), F.struct("g", F.col("v").alias("u"), beyond.alias("v"))).alias("next"))
    walk = chained(links)
    vertex = F.struct((-F.col("steps")).alias("k"), F.col("e.u").alias("u"), F.col("e.v").alias("v"))
    lines = walk.groupBy(F.col("e.g").alias("g"), "chain", "closed").agg(F.array_sort(F.collect_list(vertex)).alias("s"))
    lines = lines.select("g", "closed", F.concat(F.transform("s", lambda s: s["u"]), F.array(F.element_at("s", -1)["v"])).alias("line"))
    # each line was found in both directions: the one whose first step is the lesser stays
    first, back = F.struct(F.col("line")[0], F.col("line")[1]), F.struct(F.element_at("line", -1), F.element_at("line", -2))
    signed = F.aggregate(F.sequence(F.lit(0), F.size("line") - 2), F.lit(0.0), lambda t, i: t - (F.get("line", i + 1)["x"] - F.get("line", i)["x"]).cast("double") * (F.get("line", i + 1)["y"] + F.get("line", i)["y"] - 2 * F.col("line")[0]["y"]))
    return lines.where((F.col("closed") & (signed > 0)) | (~F.col("closed") & (first < back)))
