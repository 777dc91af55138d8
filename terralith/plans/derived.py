"""Registered queries of shapes made from others, masks, allocation, fitted curves and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.functions import geometry
from terralith.operators import assessment, hulls, spatial_join
from terralith.plans.registry import Registry, r4
from terralith.plans.spatial import inside
from terralith.sources import fixtures as fx
from terralith.sources import layers
from terralith.sources.fixtures import table

queries = Registry()
query = queries.add


def _with(*names: str) -> str:
    return "WITH " + ",\n".join((layers.SQL | fx.SQL)[n] for n in names)


def _ring(*corners: str):
    return F.expr("array(" + ", ".join("named_struct('x', {}, 'y', {})".format(*c.split(" ; ")) for c in corners) + ")")


@query(f"""{_with('points')}, p AS (SELECT DISTINCT kind, x, y FROM points),
d AS (SELECT a.kind, a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS t FROM p a JOIN p b ON a.kind = b.kind AND (a.x <> b.x OR a.y <> b.y)),
g AS (SELECT kind, x, y, t, lead(t) OVER w AS later, first_value(t) OVER w AS least FROM d WINDOW w AS (PARTITION BY kind, x, y ORDER BY t)),
h AS (SELECT kind, x, y FROM g GROUP BY kind, x, y HAVING max(coalesce(later, least + 2 * pi()) - t) > pi() + 1e-11),
m AS (SELECT *, avg(x) OVER (PARTITION BY kind) AS mx, avg(y) OVER (PARTITION BY kind) AS my FROM h),
o AS (SELECT kind, x - mx AS x, y - my AS y, lead(x - mx) OVER v AS nx, lead(y - my) OVER v AS ny, first_value(x - mx) OVER v AS fx, first_value(y - my) OVER v AS fy FROM m WINDOW v AS (PARTITION BY kind ORDER BY atan2(y - my, x - mx)))
SELECT kind, count(*) AS n_corners, round(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y) / 2, 1) AS area, round(sum(sqrt(power(coalesce(nx, fx) - x, 2) + power(coalesce(ny, fy) - y, 2))), 4) AS perimeter FROM o GROUP BY kind""")
def convex_hulls(spark, sf_dir):
    """Convex hull of the points of each kind."""
    h = hulls.convex_hulls(fx.points(spark, sf_dir), "kind")
    return h.select("kind", F.size("ring").cast("bigint").alias("n_corners"), F.round(geometry.area(F.col("ring")), 1).alias("area"), r4(geometry.perimeter(F.col("ring")), "perimeter"))


#: Estates with their corners cut by 300 m, and how far each is set back.
_INSET = "CASE WHEN estate_id % 11 = 0 THEN 600.0 ELSE estate_id % 8 * 50.0 END"
_LEFT = "greatest(0, 300 - inset * (2 - sqrt(2)))"


@query(f"""{_with('estates')}, i AS (SELECT *, CAST({_INSET} AS DOUBLE) AS inset FROM estates)
SELECT estate_id, round(CASE WHEN ymax - ymin <= 2 * inset THEN 0 ELSE (xmax - xmin - 2 * inset) * (ymax - ymin - 2 * inset) - 2 * {_LEFT} * {_LEFT} END, 2) AS area FROM i""")
def negative_buffers(spark, sf_dir):
    """Octagons set back by a distance of their own; those too small for it vanish."""
    ring = _ring("xmin + 300 ; ymin", "xmax - 300 ; ymin", "xmax ; ymin + 300", "xmax ; ymax - 300", "xmax - 300 ; ymax", "xmin + 300 ; ymax", "xmin ; ymax - 300", "xmin ; ymin + 300")
    left = layers.estates(spark, sf_dir).select("estate_id", geometry.eroded(ring, F.expr(f"CAST({_INSET} AS DOUBLE)")).alias("ring"))
    return left.select("estate_id", F.round(F.when(F.size("ring") < 3, 0.0).otherwise(geometry.area(F.col("ring"))), 2).alias("area"))


#: Estates with a notch of 500 m by 800 m from above.
_NOTCH = "(300 + estate_id % 7 * 100)"


@query(f"""{_with('estates')}, n AS (SELECT *, {_NOTCH} AS notch FROM estates), c AS (SELECT *, (1500000 * 750 - 400000 * (notch + 250)) / 1100000::DOUBLE AS cx FROM n)
SELECT estate_id, CASE WHEN notch >= 1000 - notch THEN xmin + notch / 2 ELSE xmin + (notch + 2000) / 2 END AS x, ymin + 500 AS y, NOT (cx > notch AND cx < notch + 500) AS centroid_inside FROM c""")
def representative_points(spark, sf_dir):
    """A point inside each notched estate, beside whether its centroid would be one."""
    ring = _ring("xmin ; ymin", "xmax ; ymin", "xmax ; ymax", f"xmin + {_NOTCH} + 500 ; ymax", f"xmin + {_NOTCH} + 500 ; ymin + 200", f"xmin + {_NOTCH} ; ymin + 200", f"xmin + {_NOTCH} ; ymax", "xmin ; ymax")
    e = layers.estates(spark, sf_dir).select("estate_id", ring.alias("ring"))
    e = e.select("estate_id", "ring", geometry.representative(F.col("ring")).alias("p"), geometry.centroid(F.col("ring")).alias("c"))
    return e.select("estate_id", "p.x", "p.y", geometry.contains(F.col("ring"), F.col("c.x"), F.col("c.y")).alias("centroid_inside"))


TRIALS = 32
_TRY_X = "xmin + (xmax - xmin) * ((estate_id * 7919 + t * 104729 + 17) % 10007 + 0.5) / 10007"
_TRY_Y = "ymin + (ymax - ymin) * ((estate_id * 15485863 + t * 32452843 + 5) % 10009 + 0.5) / 10009"


@query(f"""{_with('estates')}, c AS (SELECT estate_id, t, {_TRY_X} AS x, {_TRY_Y} AS y, xmin, ymin, xmax, ymax FROM estates, range({TRIALS}) r(t)),
i AS (SELECT * FROM c WHERE abs(x - (xmin + xmax) / 2) / (xmax - xmin) + abs(y - (ymin + ymax) / 2) / (ymax - ymin) < 0.5)
SELECT estate_id, count(i.t) AS n_inside, CAST(min(i.t) AS INT) AS trial, round(arg_min(i.x, i.t), 4) AS x, round(arg_min(i.y, i.t), 4) AS y FROM estates LEFT JOIN i USING (estate_id) GROUP BY estate_id""")
def random_points_inside(spark, sf_dir):
    """A point at random in each diamond: the first of a seeded row of trials in its bounds that falls inside."""
    ring = _ring("(xmin + xmax) / 2 ; ymin", "xmax ; (ymin + ymax) / 2", "(xmin + xmax) / 2 ; ymax", "xmin ; (ymin + ymax) / 2")
    tries = F.expr(f"transform(sequence(0, {TRIALS - 1}), t -> named_struct('t', t, 'x', CAST({_TRY_X} AS DOUBLE), 'y', CAST({_TRY_Y} AS DOUBLE)))")
    e = layers.estates(spark, sf_dir).withColumn("ring", ring).withColumn("tries", tries)
    e = e.withColumn("hits", F.filter("tries", lambda p: geometry.contains(F.col("ring"), p["x"], p["y"]))).withColumn("hit", F.get("hits", F.lit(0)))
    return e.select("estate_id", F.size("hits").cast("bigint").alias("n_inside"), F.col("hit.t").alias("trial"), r4(F.col("hit.x"), "x"), r4(F.col("hit.y"), "y"))


_VERTICES, _TOLERANCE = 13, 5
_WAVE = "(parcel_id * 31 + i * i * 17 + i * parcel_id) % 23"


@query(f"""WITH RECURSIVE {layers.SQL['parcels']}, v AS (SELECT parcel_id AS id, CAST(i AS BIGINT) AS i, 10 * i AS x, {_WAVE} AS y FROM parcels, range({_VERTICES}) r(i)),
seg(id, i, j) AS (SELECT parcel_id, 0::BIGINT, {_VERTICES - 1}::BIGINT FROM parcels
  UNION ALL SELECT id, unnest([i, m]), unnest([m, j]) FROM (
    SELECT s.id, s.i, s.j, 99 - max(abs((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) * 100 + 99 - p.i) % 100 AS m,
      max(abs((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x))) AS far, max((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len2
    FROM seg s JOIN v a ON a.id = s.id AND a.i = s.i JOIN v b ON b.id = s.id AND b.i = s.j JOIN v p ON p.id = s.id AND p.i > s.i AND p.i < s.j GROUP BY s.id, s.i, s.j)
  WHERE far * far > {_TOLERANCE ** 2} * len2)
SELECT id AS parcel_id, {_VERTICES}::BIGINT AS n_before, count(*) AS n_after, string_agg(CAST(i AS VARCHAR), ' ' ORDER BY i) AS kept FROM (SELECT DISTINCT id, i FROM seg UNION SELECT id, j FROM seg) GROUP BY id""")
def simplified_lines(spark, sf_dir):
    """Douglas-Peucker over one wavy line a parcel: which vertices stay, and how many fewer they are."""
    line = F.expr(f"transform(sequence(0, {_VERTICES - 1}), i -> named_struct('x', CAST(10 * i AS DOUBLE), 'y', CAST({_WAVE} AS DOUBLE)))")
    every = layers.parcels(spark, sf_dir).select("parcel_id", line.alias("line"))
    # equal lines are thinned once
    thin = spatial_join.spread(every.select("line").distinct()).select("line", hulls.simplify(F.col("line"), _TOLERANCE).alias("at"))
    p = every.join(thin, "line").select("parcel_id", F.size("line").cast("bigint").alias("n_before"), "at")
    return p.select("parcel_id", "n_before", F.size("at").cast("bigint").alias("n_after"), F.array_join("at", " ").alias("kept"))


_BASIN = "value < 250 AND abs(row * 48 - col * 36) <= 480"


@query(f"""{_with('cells')}, m AS (SELECT row, col FROM cells WHERE {_BASIN}), g AS (SELECT r AS row, c AS col FROM range(36) a(r), range(48) b(c)), o AS (SELECT dr, dc FROM range(-1, 2) a(dr), range(-1, 2) b(dc)),
wide AS (SELECT DISTINCT row + dr AS row, col + dc AS col FROM m, o)
SELECT CAST(g.row AS INT) AS row, CAST(g.col AS INT) AS col, NOT EXISTS (SELECT 1 FROM m WHERE m.row = g.row AND m.col = g.col) AS filled FROM g
WHERE NOT EXISTS (SELECT 1 FROM o WHERE NOT EXISTS (SELECT 1 FROM wide w WHERE w.row = g.row + o.dr AND w.col = g.col + o.dc))""")
def reservoir_mask(spark, sf_dir):
    """Low cells with data in a corridor, and the gaps and bays a cell wide that closing (wider, then narrower) fills."""
    near = "inline(flatten(transform(sequence(-1, 1), dr -> transform(sequence(-1, 1), dc -> named_struct('row', row + dr, 'col', col + dc)))))"
    mask = fx.cells(spark, sf_dir).where(_BASIN).select("row", "col")
    wide = mask.selectExpr(near).distinct()
    closed = wide.selectExpr(near).groupBy("row", "col").agg(F.count("*").alias("m")).where("m = 9 AND row BETWEEN 0 AND 35 AND col BETWEEN 0 AND 47")
    return closed.join(mask.withColumn("own", F.lit(True)), ["row", "col"], "left").select("row", "col", F.col("own").isNull().alias("filled"))


_FLOOR = "CASE WHEN parcel_id % 13 = 0 THEN NULL ELSE (xmax - xmin) * (ymax - ymin) * (1 + parcel_id % 3) END"
_AT = lambda b: f"p.x >= {b}.xmin AND p.x < {b}.xmax AND p.y >= {b}.ymin AND p.y < {b}.ymax"


@query(f"""{_with('parcels', 'estates', 'districts')}, p AS (SELECT parcel_id, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y, {_FLOOR} AS floor FROM parcels),
j AS (SELECT e.estate_id, d.district_id, coalesce(sum(p.floor), 0) AS part FROM p JOIN estates e ON {_AT('e')} JOIN districts d ON {_AT('d')} GROUP BY ALL),
t AS (SELECT estate_id, sum(part) AS whole FROM j GROUP BY 1)
SELECT district_id, count(*) AS n_parts, round(sum(estate_id % 50 * 10 * CASE WHEN whole > 0 THEN part / whole ELSE 0 END), 4) AS people FROM j JOIN t USING (estate_id) GROUP BY district_id""")
def dasymetric_people(spark, sf_dir):
    """People of estates dealt over districts by the floor space of the parcels there; missing space weighs nothing."""
    p = layers.parcels(spark, sf_dir).selectExpr("parcel_id", "(xmin + xmax) / 2 AS x", "(ymin + ymax) / 2 AS y", f"{_FLOOR} AS floor")
    # parcels of one centre enter with their sum, equal estates are searched once
    box = ["xmin", "ymin", "xmax", "ymax"]
    places, every = p.groupBy("x", "y").agg(F.sum("floor").alias("floor")), layers.estates(spark, sf_dir)
    one = spatial_join.once(every, "estate_id", box).select(*box, F.col("estate_id").alias("like"))
    e = spatial_join.join_within(places, one, inside(), 1000.0).select("like", "x", "y", "floor")
    j = spatial_join.join_within(e, fx.districts(spark, sf_dir), inside()).groupBy("like", "district_id").agg(F.coalesce(F.sum("floor"), F.lit(0.0)).alias("part"))
    j = j.join(every.join(one, box).select("like", "estate_id"), "like").drop("like")
    t = j.groupBy("estate_id").agg(F.sum("part").alias("whole"))
    share = F.when(F.col("whole") > 0, F.col("part") / F.col("whole")).otherwise(0.0)
    return j.join(t, "estate_id").groupBy("district_id").agg(F.count("*").alias("n_parts"), r4(F.sum(F.col("estate_id") % 50 * 10 * share), "people"))


_LENGTHS = [2.0 * k for k in range(1, 31)]


@query(f"""WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, (900 + l_partkey % 200) * exp(-CAST(l_quantity AS DOUBLE) / 14) AS y FROM lineitem),
f AS (SELECT length, regr_slope(y, exp(-x / length)) AS b, regr_intercept(y, exp(-x / length)) AS a, regr_r2(y, exp(-x / length)) AS r2 FROM d, (SELECT unnest({_LENGTHS}::DOUBLE[]) AS length) GROUP BY length)
SELECT length, round(a, 2) AS a, round(b, 2) AS b, round(r2, 6) AS r2 FROM f ORDER BY f.r2 DESC, length LIMIT 1""")
def decay_length(spark, sf_dir):
    """Exponential decay of a value by quantity: the length that fits best of a grid, the rest in closed form."""
    d = table(spark, sf_dir, "lineitem").selectExpr("CAST(l_quantity AS DOUBLE) AS x", "(900 + l_partkey % 200) * exp(-CAST(l_quantity AS DOUBLE) / 14) AS y")
    f = assessment.decay_fit(d, "x", "y", _LENGTHS)
    return f.select("length", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), F.round("r2", 6).alias("r2"))


#: A score between 0 and 1 for each order, and what it is to foretell.
_SCORE = "CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000"
_HIT = "(o_orderkey * 7919 % 1000 + floor(o_orderkey * 7919 % 1000 / 50) % 3 * 120 + o_custkey * 31 % 700 > 900)"


def scored(spark, sf_dir, steps):
    o = table(spark, sf_dir, "orders").selectExpr(f"{_SCORE} AS score", f"{_HIT} AS hit")
    return assessment.by_score(o, "score", "hit", steps)


_SCORED = f"s AS (SELECT {_SCORE} AS score, CAST({_HIT} AS BIGINT) AS hit FROM orders)"


@query(f"""WITH {_SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS place, sum(hit) OVER w AS above, count(*) OVER w AS n_above FROM s WINDOW w AS (ORDER BY score DESC))
SELECT count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round((sum(place * hit) - sum(hit) * (sum(hit) + 1) / 2) / (sum(hit) * sum(1 - hit)), 8) AS auc, round(sum(hit * above / n_above) / sum(hit), 8) AS average_precision, round(avg(power(score - hit, 2)), 8) AS brier FROM r""")
def score_metrics(spark, sf_dir):
    """AUC, average precision and Brier score of a score in thousandths."""
    m = assessment.score_metrics(scored(spark, sf_dir, 1000), 1000)
    return m.select("n", "hits", *[F.round(c, 8).alias(c) for c in ("auc", "average_precision", "brier")])


@query(f"""WITH {_SCORED}, b AS (SELECT CAST(floor(score * 20 + 0.5) AS INT) AS score_step, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM s GROUP BY 1),
lo AS (SELECT i.score_step AS i, f.score_step AS f, t.score_step AS t, sum(m.hits) / sum(m.n) AS mean FROM b i JOIN b f ON f.score_step <= i.score_step JOIN b t ON t.score_step >= i.score_step JOIN b m ON m.score_step BETWEEN f.score_step AND t.score_step GROUP BY ALL),
k AS (SELECT i, max(least) AS calibrated FROM (SELECT i, f, min(mean) AS least FROM lo GROUP BY i, f) GROUP BY i)
SELECT score_step, n, hits, round(hits / n, 6) AS rate, round(calibrated, 6) AS calibrated FROM b JOIN k ON i = score_step""")
def isotonic_calibration(spark, sf_dir):
    """Rates by score in twentieths, and the nearest ones that never fall."""
    c = assessment.isotonic(scored(spark, sf_dir, 20))
    return c.select("score_step", "n", "hits", F.round("rate", 6).alias("rate"), F.round("calibrated", 6).alias("calibrated"))
