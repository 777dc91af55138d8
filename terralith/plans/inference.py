"""Registered queries of spatial inference, scores, inequality and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terralith.operators import features, inference, spatial_join, statistics
from terralith.plans.registry import Registry, r4
from terralith.plans.spatial import _IN, inside
from terralith.sources import fixtures as fx
from terralith.sources.fixtures import table, with_layers

queries = Registry()
query = queries.add

_VALUES = f"""{with_layers('points', 'districts')}, v AS (SELECT d.district_id AS zone_id, count(*) AS value FROM districts d JOIN points p ON {_IN} GROUP BY 1),
e AS (SELECT a.district_id AS i, b.district_id AS j FROM districts a JOIN districts b ON a.district_id <> b.district_id AND a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin)"""


def counts(spark, sf_dir):
    p = spatial_join.join_within(fx.points(spark, sf_dir), fx.districts(spark, sf_dir), inside())
    return p.groupBy(F.col("district_id").alias("zone_id")).agg(F.count("*").alias("value"))


def contiguity(spark, sf_dir):
    """Queen neighbours from geometry: districts whose bounds share a point."""
    d = fx.districts(spark, sf_dir).select("district_id", "xmin", "ymin", "xmax", "ymax")
    m = spatial_join.pairs(d, d, 8000.0).where("district_id <> r_district_id")
    return m.select(F.col("district_id").alias("i"), F.col("r_district_id").alias("j"))


_MIX = "(zone_id * 7919 + round * 104729 + zone_id * zone_id * round * 31) % 10007"


@query(f"""{_VALUES}, k AS (SELECT v.zone_id, v.value, r.range AS round FROM v, range(1, 100) r),
a AS (SELECT round, zone_id, row_number() OVER (PARTITION BY round ORDER BY zone_id) AS t FROM k), b AS (SELECT round, value, row_number() OVER (PARTITION BY round ORDER BY {_MIX}, zone_id) AS t FROM k),
d AS (SELECT a.round, a.zone_id, b.value FROM a JOIN b USING (round, t) UNION ALL SELECT 0, zone_id, value FROM v), w AS (SELECT round, avg(value) AS m, var_pop(value) AS s FROM d GROUP BY 1),
i AS (SELECT x.round, sum((x.value - w.m) * (y.value - w.m)) / (count(*) * any_value(w.s)) AS i FROM e JOIN d x ON x.zone_id = e.i JOIN d y ON y.zone_id = e.j AND y.round = x.round JOIN w ON w.round = x.round GROUP BY 1)
SELECT round(max(CASE WHEN round = 0 THEN i END), 6) AS observed, round(avg(CASE WHEN round > 0 THEN i END), 6) AS mean_shuffled,
  round((1.0 + count(*) FILTER (round > 0 AND round(i, 9) >= round((SELECT i FROM i WHERE round = 0), 9))) / 100, 4) AS p_value FROM i""")
def moran_permutation(spark, sf_dir):
    """Moran's I against 99 dealings of the same values, with a pseudo p."""
    v = counts(spark, sf_dir)
    dealt = inference.shuffled(v, 99).unionByName(v.select(F.lit(0).alias("round"), "zone_id", "value"))
    i = inference.moran_by_round(dealt, contiguity(spark, sf_dir))
    own = i.where("round = 0").select(F.col("morans_i").alias("own"))
    s = i.where("round > 0").join(F.broadcast(own))
    more = F.count_if(F.round("morans_i", 9) >= F.round("own", 9))
    return s.agg(F.round(F.max("own"), 6).alias("observed"), F.round(F.avg("morans_i"), 6).alias("mean_shuffled"), r4((1 + more) / 100, "p_value"))


@query(f"""{_VALUES}, k AS (SELECT v.zone_id, v.value, r.range AS round FROM v, range(1, 100) r),
a AS (SELECT round, zone_id, row_number() OVER (PARTITION BY round ORDER BY zone_id) AS t FROM k), b AS (SELECT round, value, row_number() OVER (PARTITION BY round ORDER BY {_MIX}, zone_id) AS t FROM k),
d AS (SELECT a.round, a.zone_id, b.value FROM a JOIN b USING (round, t) UNION ALL SELECT 0, zone_id, value FROM v), z AS (SELECT round, zone_id, value - avg(value) OVER (PARTITION BY round) AS z FROM d),
l AS (SELECT x.round, e.i AS zone_id, avg(x.z) AS lag FROM e JOIN z x ON x.zone_id = e.j GROUP BY ALL),
i AS (SELECT z.round, count(*) / count(lag) * sum(z.z * lag) / sum(z.z * z.z) AS i FROM z LEFT JOIN l USING (round, zone_id) GROUP BY z.round), o AS (SELECT i AS own FROM i WHERE round = 0)
SELECT round(any_value(own), 6) AS observed, round((any_value(own) - avg(i)) / stddev_samp(i), 5) AS z_sim,
  round(least(1.0, (1.0 + 2 * least(count(*) FILTER (round(i, 9) >= round(own, 9)), count(*) FILTER (round(i, 9) <= round(own, 9)))) / (count(*) + 1)), 4) AS p FROM i, o WHERE round > 0""")
def moran_two_sided(spark, sf_dir):
    """Moran's I with row-standardised weights against 99 dealings, two-sided, and its deviation from them."""
    v = counts(spark, sf_dir)
    dealt = inference.shuffled(v, 99).unionByName(v.select(F.lit(0).alias("round"), "zone_id", "value"))
    p = inference.permutation_p(inference.standardised_moran_by_round(dealt, contiguity(spark, sf_dir)))
    return p.select(F.round("observed", 6).alias("observed"), F.round("z_sim", 5).alias("z_sim"), F.round("p", 4).alias("p"))


_Z = "z AS (SELECT zone_id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM v), l AS (SELECT z.zone_id, z.z, avg(y.z) AS lag_z FROM z JOIN e ON e.i = z.zone_id JOIN z y ON y.zone_id = e.j GROUP BY ALL)"


@query(f"{_VALUES}, {_Z} SELECT zone_id, round(z * lag_z, 6) AS local_i, CASE WHEN z >= 0 THEN 'H' ELSE 'L' END || CASE WHEN lag_z >= 0 THEN 'H' ELSE 'L' END AS quadrant FROM l")
def local_moran(spark, sf_dir):
    m = inference.local_moran(counts(spark, sf_dir), contiguity(spark, sf_dir))
    return m.select("zone_id", F.round("local_i", 6).alias("local_i"), "quadrant")


_TAIL = "(1 / (1 + 0.3275911 * abs(g) / sqrt(2.0::DOUBLE)))"
_P = f"({_TAIL} * (0.254829592 + {_TAIL} * (-0.284496736 + {_TAIL} * (1.421413741 + {_TAIL} * (-1.453152027 + {_TAIL} * 1.061405429)))) * exp(-g * g / 2))"


@query(f"""{_VALUES}, a AS (SELECT avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM v), f AS (SELECT * FROM e UNION ALL SELECT zone_id, zone_id FROM v),
t AS (SELECT f.i AS zone_id, sum(v.value) AS t, count(*) AS w FROM f JOIN v ON v.zone_id = f.j GROUP BY 1), g AS (SELECT zone_id, CAST((t - m * w) / (s * sqrt((n * w - w * w) / (n - 1))) AS DOUBLE) AS g FROM t, a),
p AS (SELECT zone_id, g, {_P} AS p, count(*) OVER () AS n FROM g), r AS (SELECT *, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS r FROM p)
SELECT zone_id, round(g, 5) AS gi_star, round(p, 6) AS p_value, p <= 0.2 / n AS bonferroni, coalesce(p <= (SELECT max(p) FROM r WHERE p <= 0.2 * r / n), FALSE) AS fdr FROM r""")
def hot_spot_significance(spark, sf_dir):
    """Gi* with normal p values, those that stand Bonferroni's correction and those within the false discovery rate."""
    g = statistics.getis_ord(counts(spark, sf_dir), contiguity(spark, sf_dir))
    t = inference.adjusted(g.withColumn("p", inference.two_sided(F.col("gi_star"))), "p", 0.2)
    return t.select("zone_id", F.round("gi_star", 5).alias("gi_star"), F.round("p", 6).alias("p_value"), "bonferroni", "fdr")


_C = f"{with_layers('points')}, c AS (SELECT * FROM points WHERE kind <> 'SUPPLIER')"
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


def customers(spark, sf_dir):
    return fx.points(spark, sf_dir).where("kind <> 'SUPPLIER'").select("pid", "x", "y", "weight")


@query(f"""{_C}, z AS (SELECT pid, x, y, weight - avg(weight) OVER () AS z FROM c), s AS (SELECT count(*) AS n, sum(z * z) AS zz FROM z), p AS (SELECT sum(a.z * b.z) AS c, count(*) AS w FROM z a JOIN z b ON a.pid <> b.pid AND {_D2} <= 9000000)
SELECT n, w, round(n * c / (w * zz), 6) AS morans_i, round(n * (1 - n * c / (w * zz)) / (1 + n * c / (w * zz)), 3) AS effective_n FROM s, p""")
def moran_distance_band(spark, sf_dir):
    """Moran's I with weights by distance, and the sample size that so much dependence leaves."""
    c = customers(spark, sf_dir)
    m = inference.moran_within(c, "weight", 3000.0)
    i = F.col("morans_i")
    return m.select("n", "w", F.round(i, 6).alias("morans_i"), F.round(F.col("n") * (1 - i) / (1 + i), 3).alias("effective_n"))


@query(f"""{_C}, r AS (SELECT a.pid, b.weight, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS k FROM c a JOIN c b ON a.pid <> b.pid)
SELECT pid, count(*) AS n, round(avg(weight), 4) AS lag FROM r WHERE k <= 4 GROUP BY pid""")
def spatial_lag(spark, sf_dir):
    """Mean of the four nearest others."""
    c = customers(spark, sf_dir)
    v = c.select(F.col("pid").alias("zone_id"), F.col("weight").alias("value"))
    return inference.lag(v, inference.nearest_weights(c, "pid", 4, 2000.0)).select(F.col("zone_id").alias("pid"), "n", r4(F.col("lag"), "lag"))


@query(f"""{_C}, r AS (SELECT a.pid, {_D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS k FROM c a JOIN c b ON a.pid <> b.pid), d AS (SELECT sqrt(d2) AS d FROM r WHERE k = 4)
SELECT count(*) AS n, round(quantile_cont(d, 0.1), 4) AS p10, round(quantile_cont(d, 0.5), 4) AS p50, round(quantile_cont(d, 0.9), 4) AS p90, round(max(d), 4) AS most FROM d""")
def k_distance_curve(spark, sf_dir):
    """Distances to the fourth neighbour, from which a clustering radius is read."""
    p = customers(spark, sf_dir).select("pid", "x", "y")
    found = spatial_join.nearest(p, p, "pid", "pid", 5, 2000.0).where("pid <> r_pid")
    d = found.groupBy("pid").agg(F.sqrt(F.array_sort(F.collect_list("d2"))[3]).alias("d"))
    return d.agg(F.count("d").alias("n"), *[r4(F.percentile("d", q), name) for q, name in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))], r4(F.max("d"), "most"))


# ---------------------------------------------------------------- features, ranks, inequality


@query("""SELECT c_mktsegment, round(sum(c_acctbal * (c_custkey % 7 + 1)) / sum(c_custkey % 7 + 1), 4) AS weighted, round(stddev_samp(c_acctbal) / avg(c_acctbal), 6) AS variation,
  round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS richest FROM customer GROUP BY 1""")
def segment_profile(spark, sf_dir):
    """Weighted mean, variation, share of the whole and the greatest row of each group."""
    c = table(spark, sf_dir, "customer")
    w, b = F.col("c_custkey") % 7 + 1, F.col("c_acctbal")
    g = c.groupBy("c_mktsegment").agg(
        r4(F.sum(b * w) / F.sum(w), "weighted"), F.round(F.stddev_samp(b) / F.avg(b), 6).alias("variation"), F.count("*").alias("n"), F.max_by("c_custkey", F.struct(b, -F.col("c_custkey"))).alias("richest")
    )
    whole = c.agg(F.count("*").alias("whole"))
    return g.join(F.broadcast(whole)).select("c_mktsegment", "weighted", "variation", F.round(F.col("n") / F.col("whole"), 6).alias("share"), "richest")


_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, abs(corr({a}, {b})) > 0.7 AS redundant FROM lineitem" for k, a in enumerate(_COLUMNS) for b in _COLUMNS[k + 1 :]))
def correlation_matrix(spark, sf_dir):
    """Every two columns in one pass; pairs too alike to keep both."""
    return features.correlations(table(spark, sf_dir, "lineitem"), list(_COLUMNS), 0.7).select("a", "b", F.round("r", 6).alias("r"), "redundant")


_PCT = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"


@query(f"""WITH a AS (SELECT s_nationkey, avg(s_acctbal) AS bal, CAST(count(*) AS DOUBLE) AS n FROM supplier GROUP BY 1), p AS (SELECT s_nationkey, {_PCT.format(c='bal')} AS pb, {_PCT.format(c='n')} AS pn FROM a),
s AS (SELECT s_nationkey, (pb + pn) / 2 AS mean, sqrt(pb * pn) AS geometric FROM p)
SELECT s_nationkey, round(mean, 6) AS mean, round(geometric, 6) AS geometric, CAST(rank() OVER (ORDER BY round(mean, 9) DESC) AS INTEGER) - CAST(rank() OVER (ORDER BY round(geometric, 9) DESC) AS INTEGER) AS shift FROM s""")
def composite_index(spark, sf_dir):
    """Two domains as percentile ranks, their arithmetic and geometric mean, and how far a nation moves between them."""
    a = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("bal"), F.count("*").cast("double").alias("n_rows")).withColumn("one", F.lit(1))
    pct = lambda df, c, name: statistics.ranked(df, "one", c).withColumn(name, F.col("rank") / F.col("n")).drop("rank", "n")
    p = pct(pct(a, "bal", "pb"), "n_rows", "pn").select("s_nationkey", ((F.col("pb") + F.col("pn")) / 2).alias("mean"), F.sqrt(F.col("pb") * F.col("pn")).alias("geometric"))
    place = lambda c: F.rank().over(Window.orderBy(F.round(c, 9).desc()))
    return p.select("s_nationkey", F.round("mean", 6).alias("mean"), F.round("geometric", 6).alias("geometric"), (place("mean") - place("geometric")).alias("shift"))


@query("""WITH q AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS b, min(p_retailprice) AS lo, max(p_retailprice) AS hi, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part),
c AS (SELECT CAST(1 + (v > b[1])::INT + (v > b[2])::INT + (v > b[3])::INT + (v > b[4])::INT AS INTEGER) AS quantile, CAST(least(5, 1 + floor((v - lo) / (hi - lo) * 5)) AS INTEGER) AS equal, CAST(1 + (v > m - s)::INT + (v > m)::INT + (v > m + s)::INT AS INTEGER) AS deviation FROM (SELECT p_retailprice AS v FROM part), q)
SELECT quantile, equal, deviation, count(*) AS n FROM c GROUP BY ALL""")
def class_breaks(spark, sf_dir):
    """Five classes by quantiles, five of equal width and four by deviations, against each other."""
    return features.class_breaks(table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("v")), "v").groupBy("quantile", "equal", "deviation").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders GROUP BY 1), r AS (SELECT v, sum(v) OVER (ORDER BY v DESC RANGE UNBOUNDED PRECEDING) AS c, count(*) OVER (ORDER BY v DESC RANGE UNBOUNDED PRECEDING) AS k, sum(v) OVER () AS t, count(*) OVER () AS n FROM o)
SELECT any_value(n) AS n, round(CAST(max(CASE WHEN k <= n / 10 THEN c END) AS DOUBLE) / any_value(t), 6) AS top_tenth, round(sum(power(CAST(v AS DOUBLE) / t, 2)), 9) AS herfindahl FROM r""")
def concentration(spark, sf_dir):
    """Share of the top tenth of customers, and the Herfindahl index."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("v"))
    return features.concentration(o, "v", 10).select("n", F.round("top", 6).alias("top_tenth"), F.round("herfindahl", 9).alias("herfindahl"))


@query("""WITH n AS (SELECT c_nationkey AS k, count(*) AS people, avg(c_acctbal) AS access FROM customer GROUP BY 1), r AS (SELECT *, sum(people) OVER (ORDER BY access, k) AS c, sum(people) OVER () AS t FROM n)
SELECT k, people, round(access, 4) AS access, CAST(c AS BIGINT) AS reached FROM r WHERE c - people < t / 5.0""")
def worst_served(spark, sf_dir):
    """The nations with least, up to a fifth of all people."""
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("people"), F.avg("c_acctbal").alias("access"))
    return features.worst_served(n, "k", "access", "people", 0.2).select("k", "people", r4(F.col("access"), "access"), "reached")


@query("""WITH a AS (SELECT s_nationkey AS k, avg(s_acctbal) AS x, CAST(count(*) AS DOUBLE) AS y FROM supplier GROUP BY 1), z AS (SELECT k, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS y FROM a),
w AS (SELECT range AS round, ((range * 7919) % 101) / 100.0::DOUBLE AS w FROM range(1, 201)), r AS (SELECT k, round, rank() OVER (PARTITION BY round ORDER BY round(w * x + (1 - w) * y, 9) DESC) AS r FROM z, w)
SELECT k, count(*) FILTER (r <= 3) AS n_top, round(avg(r), 4) AS mean_rank FROM r GROUP BY k""")
def weight_sensitivity(spark, sf_dir):
    """How often a nation is among the best three over 200 settings of the weights."""
    a = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("x"), F.count("*").cast("double").alias("y"))
    return features.weight_sensitivity(a, "k", "x", "y", 200, 3).select("k", "n_top", r4(F.col("mean_rank"), "mean_rank"))


_SCALES = ", ".join(f"b{s} AS (SELECT floor(x / {s}000) AS i, floor(y / {s}000) AS j, count(*) AS n, avg(weight) AS w FROM points GROUP BY ALL)" for s in (2, 4, 8))


@query(f"{with_layers('points')}, {_SCALES} " + " UNION ALL ".join(f"SELECT CAST({s}000 AS INTEGER) AS size_m, count(*) AS zones, round(corr(n, w), 6) AS r, round(var_samp(n) / avg(n), 6) AS vmr FROM b{s}" for s in (2, 4, 8)))
def areal_unit_effect(spark, sf_dir):
    """The same correlation and dispersion at three sizes of zone: the modifiable areal unit problem."""
    p = fx.points(spark, sf_dir)
    out = [features.at_scale(p, s).select(F.lit(s).alias("size_m"), "zones", F.round("r", 6).alias("r"), F.round("vmr", 6).alias("vmr")) for s in (2000, 4000, 8000)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH n AS (SELECT n_regionkey AS g, n_nationkey AS k, count(*) AS people, avg(c_acctbal) AS rate FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), g AS (SELECT n_regionkey AS g, count(*) AS people, avg(c_acctbal) AS rate FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT g.g, g.people = any_value(s.people) AS nests, round(g.rate, 4) AS rate, round(any_value(s.plain) - g.rate, 4) AS plain_error, round(any_value(s.weighted) - g.rate, 4) AS weighted_error
FROM g JOIN (SELECT g, CAST(sum(people) AS BIGINT) AS people, avg(rate) AS plain, sum(rate * people) / sum(people) AS weighted FROM n GROUP BY g) s USING (g) GROUP BY g.g, g.people, g.rate""")
def nesting_check(spark, sf_dir):
    """Counts add up from nations to regions; rates only do with the people they stand for as weights."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_regionkey", "g")
    whole = c.groupBy("g").agg(F.count("*").alias("people"), F.avg("c_acctbal").alias("rate"))
    parts = c.groupBy("g", "n_nationkey").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("r"))
    up = parts.groupBy("g").agg(F.sum("n").alias("n"), F.avg("r").alias("plain"), (F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("weighted"))
    error = lambda c: (F.round(F.col(c) - F.col("rate"), 4) + 0.0).alias(f"{c}_error")
    return whole.join(up, "g").select("g", (F.col("people") == F.col("n")).alias("nests"), r4(F.col("rate"), "rate"), error("plain"), error("weighted"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def largest_rows(spark, sf_dir):
    """The ten greatest rows, ties by key: a bounded sort in every task, never a full one."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("""SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS without_orders, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS orphans,
  (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS in_both, (SELECT count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N')) AS pairs_lost""")
def key_sets(spark, sf_dir):
    """Differences and intersections of keys and of pairs of keys."""
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    pair = table(spark, sf_dir, "lineitem")
    of = lambda flag: pair.where(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    sets = [n(c.subtract(o), "without_orders"), n(o.subtract(c), "orphans"), n(c.intersect(o), "in_both"), n(of("R").subtract(of("N")), "pairs_lost")]
    return sets[0].join(F.broadcast(sets[1])).join(F.broadcast(sets[2])).join(F.broadcast(sets[3]))


@query("""WITH z AS (SELECT p_brand, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS a, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS b FROM part), c AS (SELECT p_brand, avg(a) AS ca, avg(b) AS cb, count(*) AS n FROM z GROUP BY 1)
SELECT p_brand, any_value(n) AS n, round(any_value(ca), 6) AS centre_size, round(any_value(cb), 6) AS centre_price, round(sum(power(a - ca, 2) + power(b - cb, 2)), 4) AS within_ss FROM z JOIN c USING (p_brand) GROUP BY 1""")
def cluster_summary(spark, sf_dir):
    """Groups in standardised columns: centres and sums of squares within."""
    z = features.standardised(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    g = z.groupBy("p_brand").agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in ("p_size", "p_retailprice") for name, f in (("m", F.avg), ("v", F.var_pop))])
    within = F.col("n") * (F.col("v_p_size") + F.col("v_p_retailprice"))
    return g.select("p_brand", "n", F.round("m_p_size", 6).alias("centre_size"), F.round("m_p_retailprice", 6).alias("centre_price"), r4(within, "within_ss"))


@query(f"""{with_layers('points', 'districts')}, t AS (SELECT d.district_id, count(p.pid) AS n, count(*) FILTER (p.kind = 'SUPPLIER') AS suppliers, sum(p.weight) AS weight, count(*) FILTER (p.weight < 0) AS negative, (any_value(d.xmax) - any_value(d.xmin)) * (any_value(d.ymax) - any_value(d.ymin)) / 1000000 AS km2,
  sqrt(power((any_value(d.xmin) + any_value(d.xmax)) / 2 - 424000, 2) + power((any_value(d.ymin) + any_value(d.ymax)) / 2 - 4618000, 2)) AS to_core FROM districts d LEFT JOIN points p ON {_IN} GROUP BY 1)
SELECT district_id, n, suppliers, round(n / km2, 6) AS density, round(weight, 2) AS weight, round(CAST(negative AS DOUBLE) / nullif(n, 0), 6) AS share_negative, round(to_core, 3) AS to_core, round(ln(1 + n) * to_core / 1000, 6) AS interaction FROM t""")
def feature_table(spark, sf_dir):
    """One row a district: counts, density, sums, shares, distance and an interaction, from one join."""
    d = fx.districts(spark, sf_dir)
    p = spatial_join.join_within(fx.points(spark, sf_dir), d, inside()).groupBy("district_id")
    a = p.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "SUPPLIER").alias("suppliers"), F.sum("weight").alias("weight"), F.count_if(F.col("weight") < 0).alias("negative"))
    t = d.join(a, "district_id", "left").fillna(0, ["n", "suppliers", "negative"])
    km2, core = F.expr("(xmax - xmin) * (ymax - ymin) / 1000000"), F.expr("sqrt(power((xmin + xmax) / 2 - 424000, 2) + power((ymin + ymax) / 2 - 4618000, 2))")
    n = F.col("n")
    return t.select(
        "district_id", "n", "suppliers", F.round(n / km2, 6).alias("density"), F.round("weight", 2).alias("weight"), F.round(F.col("negative") / F.when(n > 0, n), 6).alias("share_negative"),
        F.round(core, 3).alias("to_core"), F.round(F.log(1 + n) * core / 1000, 6).alias("interaction"),
    )


@query(f"""{_C}, b AS (SELECT pid, weight < 0 AS y, CAST((floor(x / 6000) * 31 + floor(y / 6000) * 17) % 5 AS INTEGER) AS fold, sqrt(power(x - 424000, 2) + power(y - 4618000, 2)) AS s FROM c),
r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY s) + (count(*) OVER (PARTITION BY fold, s) - 1) / 2.0 AS r FROM b)
SELECT fold, count(*) AS n, count(*) FILTER (y) AS positives, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc FROM r GROUP BY fold""")
def auc_by_spatial_fold(spark, sf_dir):
    """Whole blocks of space make the folds; area under the curve of a score in each."""
    c = customers(spark, sf_dir)
    fold = ((F.floor(F.col("x") / 6000) * 31 + F.floor(F.col("y") / 6000) * 17) % 5).cast("int")
    score = F.sqrt(F.expr("power(x - 424000, 2) + power(y - 4618000, 2)"))
    a = features.auc(c.select(fold.alias("fold"), score.alias("s"), (F.col("weight") < 0).alias("y")), "fold", "s", "y")
    return a.select("fold", "n", "positives", F.round("auc", 6).alias("auc"))
