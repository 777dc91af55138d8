"""Curves and scores fitted and judged from counts, so that no row is sorted or collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decay_fit(rows: DataFrame, x: str, y: str, lengths: list[float]) -> DataFrame:
    """length, a, b, r2 of y = a + b exp(-x / length): for each length the linear fit in closed form, of which the one
    with least error stays (the shorter of equals). Rows are summed by x once, whatever the number of lengths."""
    sums = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"))
    v = F.col(y).cast("double")
    sums = sums.agg(F.count("*").alias("n"), F.sum(v).alias("y"), F.sum(v * v).alias("yy"))
    each = sums.withColumn("length", F.explode(F.array(*[F.lit(float(s)) for s in lengths]))).withColumn("e", F.exp(-F.col("x") / F.col("length")))
    t = each.groupBy("length").agg(*[F.expr(f"sum({e})").alias(c) for c, e in {"n": "n", "e": "n * e", "ee": "n * e * e", "y": "y", "ye": "y * e", "yy": "yy"}.items()])
    t = t.withColumn("b", F.expr("(n * ye - e * y) / (n * ee - e * e)")).withColumn("a", F.expr("(y - b * e) / n"))
    t = t.withColumn("total", F.expr("yy - y * y / n")).withColumn("r2", F.expr("b * (ye - e * y / n) / total"))
    return t.agg(F.max_by(F.struct("length", "a", "b", "r2"), F.struct("r2", -F.col("length"))).alias("best")).select("best.*")


def by_score(rows: DataFrame, score: str, label: str, steps: int) -> DataFrame:
    """score_step, n, hits: rows counted by their score (0 to 1) in whole steps: steps + 1 rows at most."""
    step = F.round(F.col(score) * steps).cast("int").alias("score_step")
    return rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(step).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("hits"))


def score_metrics(counts: DataFrame, steps: int) -> DataFrame:
    """n, hits, auc, average_precision, brier of a table of by_score; equal scores count as one threshold."""
    s = F.col("score_step") / steps
    down, up = Window.orderBy(F.desc("score_step")), Window.orderBy("score_step").rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumn("n_above", F.sum("n").over(down)).withColumn("hits_above", F.sum("hits").over(down)).withColumn("misses_below", F.coalesce(F.sum(F.col("n") - F.col("hits")).over(up), F.lit(0)))
    misses = F.sum(F.col("n") - F.col("hits"))
    return c.agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"),
        (F.sum(F.col("hits") * (F.col("misses_below") + (F.col("n") - F.col("hits")) / 2)) / (F.sum("hits") * misses)).alias("auc"),
        (F.sum(F.col("hits") * F.col("hits_above") / F.col("n_above")) / F.sum("hits")).alias("average_precision"),
        (F.sum(F.col("hits") * (1 - s) * (1 - s) + (F.col("n") - F.col("hits")) * s * s) / F.sum("n")).alias("brier"),
    )


def isotonic(counts: DataFrame) -> DataFrame:
    """counts with rate and calibrated: the rates that never fall with the score and are nearest to those counted."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    binned = counts.withColumn("rate", F.col("hits") / F.col("n")).withColumn("weight", F.col("n").cast("double"))
    ready = VectorAssembler(inputCols=["score_step"], outputCol="at").transform(binned)
    model = IsotonicRegression(featuresCol="at", labelCol="rate", weightCol="weight", predictionCol="calibrated").fit(ready)
    return model.transform(ready).drop("at", "weight")
