"""Polygons of several parts with holes, point location and predicates, as Column expressions.

A polygon is an array of parts struct<shell: ring, holes: array<ring>>; a ring is an open array of struct<x, y>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralith.functions import geometry


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def area(parts: Column) -> Column:
    """Shells less holes; 0 for an empty polygon."""
    holes = lambda p: _sum(F.transform(p["holes"], geometry.area))
    return _sum(F.transform(parts, lambda p: geometry.area(p["shell"]) - holes(p)))


def perimeter(parts: Column) -> Column:
    holes = lambda p: _sum(F.transform(p["holes"], geometry.perimeter))
    return _sum(F.transform(parts, lambda p: geometry.perimeter(p["shell"]) + holes(p)))


def vertices(parts: Column) -> Column:
    """Number of vertices of all rings, the closing one not counted."""
    holes = lambda p: F.aggregate(p["holes"], F.lit(0), lambda a, h: a + F.size(h))
    return F.aggregate(parts, F.lit(0), lambda a, p: a + F.size(p["shell"]) + holes(p))


def kind(parts: Column) -> Column:
    return F.when(F.size(parts) == 0, "Empty").when(F.size(parts) == 1, "Polygon").otherwise("MultiPolygon")


def bounds(ring: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax> of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def _turn(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def on_segment(px, py, ax, ay, bx, by) -> Column:
    inside = px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))
    return (_turn(ax, ay, bx, by, px, py) == 0) & inside


def locate(ring: Column, x: Column, y: Column) -> Column:
    """I, B or E: the point is in the interior, on the boundary or outside."""
    edge = F.exists(geometry.edges(ring), lambda e: on_segment(x, y, e["ax"], e["ay"], e["bx"], e["by"]))
    return F.when(edge, "B").when(geometry.contains(ring, x, y), "I").otherwise("E")


def _apart(e: Column, f: Column) -> Column:
    """The bounds of two segments share no point: most pairs of edges go no further."""
    side = lambda c: (F.greatest(e[f"a{c}"], e[f"b{c}"]) < F.least(f[f"a{c}"], f[f"b{c}"])) | (F.greatest(f[f"a{c}"], f[f"b{c}"]) < F.least(e[f"a{c}"], e[f"b{c}"]))
    return side("x") | side("y")


def segments_meet(e: Column, f: Column) -> Column:
    """Closed segments share a point: with bounds that do, neither lies strictly to one side of the other."""
    side = lambda s, t: _turn(s["ax"], s["ay"], s["bx"], s["by"], t["ax"], t["ay"]) * _turn(s["ax"], s["ay"], s["bx"], s["by"], t["bx"], t["by"])
    return ~_apart(e, f) & (side(e, f) <= 0) & (side(f, e) <= 0)


def intersects(a: Column, b: Column) -> Column:
    """Two rings share a point: edges meet, or one holds the other."""
    cross = lambda ea, eb: F.exists(ea, lambda e: F.exists(eb, lambda f: segments_meet(e, f)))
    edges = geometry.let(F.struct(geometry.edges(a).alias("a"), geometry.edges(b).alias("b")), lambda s: cross(s["a"], s["b"]))
    return edges | geometry.contains(a, b[0]["x"], b[0]["y"]) | geometry.contains(b, a[0]["x"], a[0]["y"])


def distance(a: Column, b: Column) -> Column:
    """0 where two rings share a point, else the least distance of a vertex of one and an edge of the other."""
    to_edges = lambda p, edges: F.array_min(F.transform(edges, lambda e: geometry.segment_distance2(p["x"], p["y"], e["ax"], e["ay"], e["bx"], e["by"])))
    far = lambda ring, other: geometry.let(geometry.edges(other), lambda edges: F.array_min(F.transform(ring, lambda p: to_edges(p, edges))))
    return F.when(intersects(a, b), 0.0).otherwise(F.sqrt(F.least(far(a, b), far(b, a))))


def _cuts(e: Column, f: Column) -> Column:
    """Where along e (0 to 1) the segment f crosses or touches it, both ends of a stretch in common."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    at = lambda x, y: ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / (dx * dx + dy * dy)
    start, end = _turn(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"]), _turn(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
    share = F.when(start != end, start / F.when(start != end, start - end)).otherwise(0.0)
    crossing = F.array(at(f["ax"] + share * (f["bx"] - f["ax"]), f["ay"] + share * (f["by"] - f["ay"])))
    level = F.array(at(f["ax"], f["ay"]), at(f["bx"], f["by"]))
    return F.when(~segments_meet(e, f), F.slice(crossing, 1, 0)).when(start == end, level).otherwise(crossing)


def boundary_places(a: Column, b: Column) -> Column:
    """Where the pieces of a's boundary between its meetings with b's lie: array of I, E, and S or O on b's boundary,
    in the same or the opposite direction."""

    def place(x, y, dx, dy, ring, edges):
        under = F.get(F.filter(edges, lambda f: on_segment(x, y, f["ax"], f["ay"], f["bx"], f["by"])), F.lit(0))
        same = (under["bx"] - under["ax"]) * dx + (under["by"] - under["ay"]) * dy > 0
        return F.when(under.isNotNull(), F.when(same, "S").otherwise("O")).when(geometry.contains(ring, x, y), "I").otherwise("E")

    def pieces(e, ring, edges):
        inner = F.filter(F.flatten(F.transform(edges, lambda f: _cuts(e, f))), lambda t: (t > 0) & (t < 1))
        ends = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        middle = lambda t: place(e["ax"] + t * dx, e["ay"] + t * dy, dx, dy, ring, edges)
        spans = lambda ts: F.zip_with(F.slice(ts, F.lit(1), F.size(ts) - 1), F.slice(ts, F.lit(2), F.size(ts) - 1), lambda t, u: (t + u) / 2)
        return geometry.let(ends, lambda ts: F.transform(spans(ts), middle))

    both = F.struct(geometry.edges(a).alias("a"), geometry.edges(b).alias("b"), b.alias("ring"))
    return geometry.let(both, lambda s: F.array_distinct(F.flatten(F.transform(s["a"], lambda e: pieces(e, s["ring"], s["b"])))))


PREDICATES = ("intersects", "disjoint", "touches", "within", "contains", "overlaps", "equals")


def relation(a: Column, b: Column) -> dict[str, Column]:
    """The predicates of relations one by one; where several are wanted, name the struct first."""
    return {c: relations(a, b)[c] for c in PREDICATES}


def relations(a: Column, b: Column) -> Column:
    """struct of the predicates of two simple counterclockwise rings, from where their boundaries lie."""
    own = F.struct(intersects(a, b).alias("meet"), boundary_places(a, b).alias("a"), boundary_places(b, a).alias("b"))

    def named(s):
        has = lambda c, *places: F.arrays_overlap(s[c], F.array(*map(F.lit, places)))
        inner = has("a", "I", "S") | has("b", "I")
        within, contains = inner & ~has("a", "E", "O") & ~has("b", "I"), inner & ~has("b", "E", "O") & ~has("a", "I")
        values = (s["meet"], ~s["meet"], s["meet"] & ~inner, within, contains, inner & ~within & ~contains, within & contains)
        return F.struct(*[v.alias(c) for c, v in zip(PREDICATES, values, strict=True)])

    return geometry.let(own, named)


def inside_share(line: Column, ring: Column) -> Column:
    """struct<t0, t1>: the part of a segment struct<ax, ay, bx, by> inside a convex counterclockwise ring,
    t1 <= t0 where there is none in the interior."""

    def cut(t, e):
        start = _turn(e["ax"], e["ay"], e["bx"], e["by"], line["ax"], line["ay"])
        end = _turn(e["ax"], e["ay"], e["bx"], e["by"], line["bx"], line["by"])
        at = start / F.when(start != end, start - end)
        t0 = F.when((start < 0) & (end > 0), F.greatest(t["t0"], at)).otherwise(t["t0"])
        t1 = F.when((start > 0) & (end < 0), F.least(t["t1"], at)).when((start <= 0) & (end <= 0), F.lit(-1.0)).otherwise(t["t1"])
        return F.struct(t0.alias("t0"), t1.alias("t1"))

    return F.aggregate(geometry.edges(ring), F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1")), cut)


def crosses(line: Column, ring: Column) -> Column:
    """A part of the segment lies in the interior and a part outside."""
    t = inside_share(line, ring)
    return (t["t1"] > t["t0"]) & ((t["t0"] > 0) | (t["t1"] < 1))


def is_simple(ring: Column) -> Column:
    """No two edges meet but neighbours at their common vertex: these may not fold back on each other."""

    def clash(p, q, n):
        follows, wraps = q["i"] == p["i"] + 1, (p["i"] == 0) & (q["i"] == n - 1)
        e, f = p["e"], q["e"]
        ex, ey, fx, fy = e["bx"] - e["ax"], e["by"] - e["ay"], f["bx"] - f["ax"], f["by"] - f["ay"]
        folds = (ex * fy - ey * fx == 0) & (ex * fx + ey * fy <= 0)
        return F.when(q["i"] <= p["i"], False).when(follows | wraps, folds).otherwise(segments_meet(e, f))

    indexed = F.transform(geometry.edges(ring), lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    return geometry.let(indexed, lambda s: ~F.exists(s, lambda p: F.exists(s, lambda q: clash(p, q, F.size(s)))))


def untie(ring: Column) -> Column:
    """The two triangles of a quadrilateral whose first and third edges cross, as an array of rings."""
    a, b, c, d = (ring[k] for k in range(4))
    t = _turn(c["x"], c["y"], d["x"], d["y"], a["x"], a["y"])
    u = _turn(c["x"], c["y"], d["x"], d["y"], b["x"], b["y"])
    at = F.struct((a["x"] + (b["x"] - a["x"]) * t / (t - u)).alias("x"), (a["y"] + (b["y"] - a["y"]) * t / (t - u)).alias("y"))
    return F.array(F.array(a, at, d), F.array(at, b, c))


def snapped(ring: Column, grid: float) -> Column:
    """Vertices on a grid, repeated neighbours dropped; no vertices where the ring collapses."""
    moved = F.transform(ring, lambda p: F.struct((F.floor(p["x"] / grid + 0.5) * grid).alias("x"), (F.floor(p["y"] / grid + 0.5) * grid).alias("y")))
    before = lambda i: F.get(moved, F.when(i == 0, F.size(moved) - 1).otherwise(i - 1))
    kept = F.filter(moved, lambda p, i: p != before(i))
    return F.when(F.size(F.array_distinct(kept)) < 3, F.slice(kept, 1, 0)).otherwise(kept)


def hausdorff(a: Column, b: Column) -> Column:
    """Discrete Hausdorff distance of two vertex lists."""
    d2 = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    far = lambda s, t: F.array_max(F.transform(s, lambda p: F.array_min(F.transform(t, lambda q: d2(p, q)))))
    return F.sqrt(F.greatest(far(a, b), far(b, a)))


def moved(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def along(line: Column, share: Column) -> Column:
    """The point at a share of a segment's length."""
    return F.struct((line["ax"] + share * (line["bx"] - line["ax"])).alias("x"), (line["ay"] + share * (line["by"] - line["ay"])).alias("y"))


def line_distance(line: Column, x: Column, y: Column) -> Column:
    return F.sqrt(geometry.segment_distance2(x, y, line["ax"], line["ay"], line["bx"], line["by"]))
