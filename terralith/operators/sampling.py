"""Weighted sampling by cumulative weights: prefix sums without a global window, draws met by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(rows: DataFrame, order: str, value: str, parts: int = 256) -> DataFrame:
    """rows with before and upto: sums of value over all rows with a lesser order, and with their own.

    Ranges of order between approximate quantiles are summed first; a window sorts one range only. Order is to be a
    key without ties; null values count 0.
    """
    v = F.coalesce(F.col(value), F.lit(0)).cast("double")
    bounds = rows.agg(F.percentile_approx(order, F.array(*[F.lit(k / parts) for k in range(1, parts)])).alias("b")).first()["b"] or []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    cut = rows.withColumn("__part", part)
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = cut.groupBy("__part").agg(F.sum(v).alias("__s")).select("__part", F.coalesce(F.sum("__s").over(ahead), F.lit(0.0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.join(F.broadcast(starts), "__part").withColumn("upto", F.col("__start") + F.sum(v).over(inside))
    return summed.withColumn("before", F.col("upto") - v).select(*rows.columns, "before", "upto")


def drawn(summed: DataFrame, draws: DataFrame, cells: int = 4096) -> DataFrame:
    """draws (u from 0 to below 1) with the row of summed (prefix_sums of weights >= 0) whose share of the whole holds u.

    Both meet in cells of the cumulative scale: a row lies in those that its interval covers.
    """
    whole = summed.agg(F.max("upto").alias("__all"))
    wide = summed.where("upto > before").join(F.broadcast(whole))
    place = lambda c: F.floor(F.least(F.lit(1.0), F.col(c) / F.col("__all")) * cells)
    wide = wide.withColumn("__cell", F.explode(F.sequence(place("before"), place("upto"))))
    at = draws.join(F.broadcast(whole)).withColumn("__u", F.col("u") * F.col("__all")).withColumn("__cell", place("__u"))
    return at.drop("__all").join(wide, "__cell").where("__u >= before AND __u < upto").drop("__cell", "__u", "__all", "before", "upto")
