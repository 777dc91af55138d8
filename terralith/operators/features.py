"""Scores, ranks, class breaks, inequality and validation measures as aggregates and small windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.statistics import value_ranks


def correlations(df: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """a, b, r, redundant of every two columns: one pass of moments."""
    names = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(names)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*", (F.abs("x.r") > limit).alias("redundant"))


def class_breaks(df: DataFrame, v: str) -> DataFrame:
    """df with its class by quintiles, by five equal widths and by standard deviations."""
    counted = df.groupBy(v).agg(F.count("*").alias("m"))
    breaks = counted.agg(
        F.expr(f"percentile({v}, array(0.2, 0.4, 0.6, 0.8), m)").alias("b"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        (F.sum(F.col(v) * F.col("m")) / F.sum("m")).alias("mean"),
    )
    spread = df.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("s"))
    j = df.join(F.broadcast(breaks.drop("mean"))).join(F.broadcast(spread))
    above = lambda limits: sum((F.when(F.col(v) > x, 1).otherwise(0) for x in limits), F.lit(1))
    wide = F.least(F.lit(5), 1 + F.floor((F.col(v) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 5)).cast("int")
    by_deviation = above([F.col("mean") - F.col("s"), F.col("mean"), F.col("mean") + F.col("s")])
    return j.select(*df.columns, above([F.col("b")[k] for k in range(4)]).alias("quantile"), wide.alias("equal"), by_deviation.alias("deviation"))


def concentration(df: DataFrame, v: str, part: int) -> DataFrame:
    """n, top (share of the greatest n / part rows, whole ties only) and herfindahl of positive values."""
    r = value_ranks(df.select((-F.col(v)).alias("v"), F.lit(1).alias("one")), "one", "v")
    whole = df.agg(F.sum(v).alias("t"))
    x = r.join(F.broadcast(whole)).withColumn("share", -F.col("v") / F.col("t"))
    top = (F.col("below") + F.col("m")) <= F.col("n") / part
    return x.agg(F.max("n").alias("n"), F.sum(F.when(top, F.col("share") * F.col("m"))).alias("top"), F.sum(F.col("m") * F.col("share") * F.col("share")).alias("herfindahl"))


def worst_served(groups: DataFrame, key: str, access: str, people: str, share: float) -> DataFrame:
    """Groups by rising access until they hold a share of all people; groups is small: one row an area."""
    w = Window.orderBy(access, key).rowsBetween(Window.unboundedPreceding, 0)
    whole = groups.agg(F.sum(people).alias("__t"))
    r = groups.withColumn("reached", F.sum(people).over(w)).join(F.broadcast(whole))
    return r.where(F.col("reached") - F.col(people) < F.col("__t") * share).drop("__t")


def weight_sensitivity(groups: DataFrame, key: str, x: str, y: str, rounds: int, best: int) -> DataFrame:
    """key, n_top, mean_rank over so many weights of two criteria, each scaled to 0..1."""
    ends = groups.agg(*[f(c).alias(f"{c}_{n}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda c: (F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo"))
    z = groups.join(F.broadcast(ends)).select(key, scaled(x).alias("x"), scaled(y).alias("y"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    w = (F.col("round") * 7919 % 101) / 100.0
    z = z.withColumn("score", F.round(w * F.col("x") + (1 - w) * F.col("y"), 9))
    r = z.withColumn("r", F.rank().over(Window.partitionBy("round").orderBy(F.desc("score"))))
    return r.groupBy(key).agg(F.count_if(F.col("r") <= best).alias("n_top"), F.avg("r").alias("mean_rank"))


def at_scale(points: DataFrame, size: int) -> DataFrame:
    """zones, r (count against mean weight) and vmr of points in square zones."""
    b = points.groupBy(F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j")).agg(F.count("*").alias("n"), F.avg("weight").alias("w"))
    return b.agg(F.count("*").alias("zones"), F.corr("n", "w").alias("r"), (F.var_samp("n") / F.avg("n")).alias("vmr"))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with mean 0 and population deviation 1."""
    whole = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: ((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}"))).alias(c)
    return df.join(F.broadcast(whole)).select(*[z(c) if c in columns else F.col(c) for c in df.columns])


def auc(df: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """by, n, positives, auc: chance that a positive row scores above a negative one, ties half."""
    r = value_ranks(df, by, score).select(by, score, ((F.col("below") + (F.col("m") + 1) / 2)).alias("rank"), "n")
    hits = df.groupBy(by, score).agg(F.count_if(F.col(label)).alias("p")).join(r, [by, score])
    s = hits.groupBy(by).agg(F.max("n").alias("n"), F.sum("p").alias("positives"), F.sum(F.col("p") * F.col("rank")).alias("r"))
    p = F.col("positives")
    pairs = p * (F.col("n") - p)
    return s.select(by, "n", "positives", ((F.col("r") - p * (p + 1) / 2) / F.when(pairs > 0, pairs)).alias("auc"))
