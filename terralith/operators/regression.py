"""Linear regression with inference: one pass of moments over all rows, a solve of p x p numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_sided_t(t: float, freedom: float) -> float:
    """Chance of a value of Student's t at least as far from 0: the incomplete beta function by its continued fraction."""
    if math.isnan(t) or freedom <= 0:
        return float("nan")
    x = freedom / (freedom + t * t)
    a, b, flip = freedom / 2, 0.5, False
    if x > (a + 1) / (a + b + 2):
        a, b, x, flip = b, a, 1 - x, True
    if x <= 0:
        return 1.0 if flip else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h if flip else front * h


def fit(rows: DataFrame, xs: list[str], y: str) -> dict:
    """names, b, se, t, p, and n, r2, adjusted, aic, s2 of y on an intercept and xs; rows with a null are left out.

    Sums are taken about the first moments, so large means lose no digits. Columns that depend on each other, or too
    few rows, leave coefficients without errors (nan).
    """
    names = [*xs, y]
    sound = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    one = sound.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]).first()
    n, p = one["n"], len(xs)
    if n <= p + 1:
        none = [float("nan")] * (p + 1)
        return {"names": ["intercept", *xs], "b": none, "se": none, "t": none, "p": none, "n": n, "r2": float("nan"), "adjusted": float("nan"), "aic": float("nan"), "s2": float("nan")}
    cov = np.array([[one[f"c_{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
    mean = np.array([one[f"m_{c}"] for c in names])
    inverse = np.linalg.inv(cov[:p, :p]) if np.linalg.matrix_rank(cov[:p, :p]) == p else np.full((p, p), np.nan)
    slopes = inverse @ cov[:p, p]
    b = np.append(mean[p] - mean[:p] @ slopes, slopes)
    total, freedom = n * cov[p, p], n - p - 1
    rest = n * (cov[p, p] - slopes @ cov[:p, p])
    s2 = rest / freedom
    spread = np.append(1 / n + mean[:p] @ inverse @ mean[:p] / n, np.diag(inverse) / n)
    se = np.sqrt(s2 * spread)
    t = b / se
    r2 = 1 - rest / total if total > 0 else float("nan")
    likelihood = -n / 2 * (math.log(2 * math.pi * rest / n) + 1) if rest > 0 else float("inf")
    chance = [two_sided_t(float(v), freedom) for v in t]
    return {"names": ["intercept", *xs], "b": b.tolist(), "se": se.tolist(), "t": t.tolist(), "p": chance, "n": n, "r2": r2, "adjusted": 1 - (1 - r2) * (n - 1) / freedom, "aic": 2 * (p + 1) - 2 * likelihood, "s2": s2}


def table_of(spark, found: dict) -> DataFrame:
    """term, b, se, t, p, n, r2, adjusted, aic: a row a term."""
    rows = [(k, *map(float, v), int(found["n"]), *(float(found[c]) for c in ("r2", "adjusted", "aic"))) for k, *v in zip(*(found[c] for c in ("names", "b", "se", "t", "p")), strict=True)]
    return spark.createDataFrame(rows, "term string, b double, se double, t double, p double, n long, r2 double, adjusted double, aic double")


def residuals(rows: DataFrame, found: dict, xs: list[str], y: str) -> DataFrame:
    """rows with residual; null where a column is."""
    fitted = F.lit(found["b"][0])
    for c, b in zip(xs, found["b"][1:], strict=True):
        fitted = fitted + F.lit(b) * F.col(c)
    return rows.withColumn("residual", F.col(y) - fitted)


def lagged(rows: DataFrame, key: str, columns: list[str], edges: DataFrame) -> DataFrame:
    """rows with w_column: mean of the neighbours' values (edges i, j) that aren't null; null without any."""
    far = rows.select(F.col(key).alias("j"), *[F.col(c).alias(f"w_{c}") for c in columns])
    means = edges.join(far, "j").groupBy(F.col("i").alias(key)).agg(*[F.avg(f"w_{c}").alias(f"w_{c}") for c in columns])
    return rows.join(means, key, "left")


def residual_moran(rows: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """One row: n and Moran's I of residual under row-standardised weights."""
    e = rows.where("residual IS NOT NULL").select(key, "residual")
    mean = e.agg(F.avg("residual").alias("m"))
    z = e.join(F.broadcast(mean)).select(key, (F.col("residual") - F.col("m")).alias("residual"))
    w = lagged(z, key, ["residual"], edges)
    return w.agg(F.count("*").alias("n"), F.count("w_residual").alias("s0"), F.sum(F.col("residual") * F.col("w_residual")).alias("c"), F.sum(F.col("residual") * F.col("residual")).alias("v")).select("n", (F.col("n") / F.col("s0") * F.col("c") / F.col("v")).alias("morans_i"))
