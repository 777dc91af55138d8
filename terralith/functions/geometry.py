"""Planar geometry as Column expressions over rings: arrays of struct<x, y>, not closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda that names an expression evaluates it anew each time."""
    return F.transform(F.array(value), body)[0]


def _edges(ring: Column, term) -> Column:
    """term(a, b) of every edge, the closing one included."""
    ahead = lambda r: F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    return let(ring, lambda r: F.zip_with(r, ahead(r), term))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(ring: Column) -> Column:
    """Shoelace formula about the first vertex, which keeps large coordinates exact; positive if counterclockwise."""

    def shoelace(ring):
        o = ring[0]
        return _total(_edges(ring, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))) / 2

    return let(ring, shoelace)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _total(_edges(ring, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))))


def centroid(ring: Column) -> Column:
    """Area-weighted; may lie outside a ring that isn't convex."""

    def middle(ring):
        o = ring[0]
        cross = lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])
        along = lambda c, six: o[c] + _total(_edges(ring, lambda a, b: (a[c] + b[c] - 2 * o[c]) * cross(a, b))) / six
        return let(6 * signed_area(ring), lambda six: F.struct(along("x", six).alias("x"), along("y", six).alias("y")))

    return let(ring, middle)


def compactness(ring: Column) -> Column:
    """Polsby-Popper: 1 for a disc."""
    return let(ring, lambda r: 4 * 3.141592653589793 * area(r) / F.pow(perimeter(r), F.lit(2)))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting to the right: an odd number of edges is crossed. Edges are half open.

    x and y enter as fields of one value: attributes of two tables that meet only inside a lambda were once pushed below
    the join that brings them together.
    """

    def odd(s):
        def crossed(a, b):
            spans = (a["y"] > s["y"]) != (b["y"] > s["y"])
            return F.when(spans & (s["x"] < (b["x"] - a["x"]) * (s["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

        return F.aggregate(_edges(s["ring"], crossed), F.lit(0), lambda n, c: n + c) % 2 == 1

    return let(F.struct(ring.alias("ring"), x.alias("x"), y.alias("y")), odd)


def on_slant(ring: Column, x: Column, y: Column) -> Column:
    """The point lies on an edge of the ring that is neither level nor upright."""

    def hit(s):
        def lies(e):
            dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
            between = s["x"].between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
            return (dx != 0) & (dy != 0) & between & (dx * (s["y"] - e["ay"]) == dy * (s["x"] - e["ax"]))

        return F.exists(edges(s["ring"]), lies)

    return let(F.struct(ring.alias("ring"), x.alias("x"), y.alias("y")), hit)


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point and a segment."""
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    t = F.when(long2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / long2)))
    return let(t, lambda t: F.pow(ax + t * dx - px, F.lit(2)) + F.pow(ay + t * dy - py, F.lit(2)))


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """0 inside the ring, else the distance to its nearest edge."""
    far = lambda r: F.sqrt(F.array_min(_edges(r, lambda a, b: segment_distance2(x, y, a["x"], a["y"], b["x"], b["y"]))))
    return let(ring, lambda r: F.when(contains(r, x, y), 0.0).otherwise(far(r)))


def overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Area that two boxes share."""
    w = F.least(ax1, bx1) - F.greatest(ax0, bx0)
    h = F.least(ay1, by1) - F.greatest(ay0, by0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Counterclockwise ring of a box."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax))])


def buffer_point(x: Column, y: Column, radius: Column, quadrant: int = 16) -> Column:
    """Ring of 4 * quadrant vertices on the circle about a point."""
    turn = lambda k: k * (3.141592653589793 / 2 / quadrant)
    return F.transform(F.sequence(F.lit(0), F.lit(4 * quadrant - 1)), lambda k: F.struct((x + radius * F.cos(turn(k))).alias("x"), (y + radius * F.sin(turn(k))).alias("y")))


def clip_convex(ring: Column, mask: Column) -> Column:
    """The part of a ring inside a convex counterclockwise mask (Sutherland-Hodgman); no vertices if nothing is shared."""
    return left_of(ring, _edges(mask, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def eroded(ring: Column, inset: Column) -> Column:
    """Negative buffer of a convex counterclockwise ring: what is left of every side moved inwards; no vertices if nothing is."""

    def inward(a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        by = inset / F.sqrt(dx * dx + dy * dy)
        move = lambda p: F.struct((p["x"] - dy * by).alias("x"), (p["y"] + dx * by).alias("y"))
        return F.struct(move(a).alias("a"), move(b).alias("b"))

    return left_of(ring, _edges(ring, inward))


def representative(ring: Column) -> Column:
    """A point inside: the middle of the widest inner interval at half height, the left one of equals; null without any."""
    ys = F.transform(ring, lambda p: p["y"])
    y = (F.array_min(ys) + F.array_max(ys)) / 2
    meets = F.filter(edges(ring), lambda e: (e["ay"] > y) != (e["by"] > y))
    xs = F.array_sort(F.transform(meets, lambda e: e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])))
    starts = F.when(F.size(xs) >= 2, F.sequence(F.lit(0), (F.size(xs) / 2).cast("int") - 1))
    widest = F.array_max(F.transform(starts, lambda k: F.struct((xs[2 * k + 1] - xs[2 * k]).alias("width"), (-xs[2 * k]).alias("west"))))
    return F.when(F.size(xs) >= 2, F.struct((widest["width"] / 2 - widest["west"]).alias("x"), y.alias("y")))


def left_of(ring: Column, sides: Column) -> Column:
    """The part of a ring to the left of every line struct<a, b> of sides, cut by one after the other."""

    def cut(kept, side):
        a, b = side["a"], side["b"]
        left = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

        def edge(p, q):
            t = p["left"] / (p["left"] - q["left"])
            at = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
            end = F.struct(q["x"].alias("x"), q["y"].alias("y"))
            here, there = p["left"] >= 0, q["left"] >= 0
            return F.when(here & there, F.array(end)).when(here, F.array(at)).when(there, F.array(at, end)).otherwise(F.slice(F.array(end), 1, 0))

        sided = F.transform(kept, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), left(p).alias("left")))
        return F.flatten(_edges(sided, edge))

    return F.aggregate(sides, ring, cut)


def edges(ring: Column) -> Column:
    """Array of struct<ax, ay, bx, by>, the closing edge included."""
    return _edges(ring, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
