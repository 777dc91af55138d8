"""Losses by return period and what they come to in a year and over years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interpolated(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots (x rising), constant beyond both ends."""
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(x <= x1, y0 + (x - x0) * (y1 - y0) / (x1 - x0)).otherwise(out)
    return F.when(x <= knots[0][0], F.lit(knots[0][1])).otherwise(out)


def losses(buildings: DataFrame, levels: dict[int, float], curve: list[tuple[float, float]], factor: float = 1.0) -> DataFrame:
    """buildings (ground, value) at each return period: period, depth, loss."""
    periods = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(float(v)).alias("level")) for p, v in sorted(levels.items())])
    each = buildings.withColumn("t", F.explode(periods)).withColumn("depth", F.col("t.level") - F.col("ground"))
    share = F.least(F.lit(1.0), factor * interpolated(F.col("depth"), curve))
    return each.select(*buildings.columns, "t.period", "depth", (F.col("value") * share).alias("loss"))


def expected_annual(buildings: DataFrame, by: str, levels: dict[int, float], curve: list[tuple[float, float]], factor: float = 1.0) -> DataFrame:
    """by, ead: trapezoids over the yearly chances between neighbouring return periods."""
    sums = losses(buildings, levels, curve, factor).groupBy(by, "period").agg(F.sum("loss").alias("loss"))
    w = Window.partitionBy(by).orderBy("period")
    step = sums.select(by, "period", "loss", F.lead("loss").over(w).alias("next"), F.lead("period").over(w).alias("later")).where("later IS NOT NULL")
    part = (F.col("loss") + F.col("next")) / 2 * (1.0 / F.col("period") - 1.0 / F.col("later"))
    return step.groupBy(by).agg(F.sum(part).alias("ead"))


def present_value_factor(rate: float, years: int) -> float:
    return (1 - (1 + rate) ** -years) / rate
