"""Models with folds: Spark ML fitted once a fold, predictions for rows that it has not seen, and what they rest on.

Feature tables hold a key, numbers, and a 0/1 label. Rows with a missing feature are dropped first (complete). Every
random choice is a hash of the key or a fixed seed, so that reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.graph import cut
from terralith.operators.statistics import value_ranks

SEED = 42


@dataclass
class Logistic:
    """Without a penalty, by Newton's method from zero: one pass over the rows a step, rounds steps at most.

    Features enter as differences from their means: values that hardly vary beside their size (a distance of 90 m, give or take
    a few) would else be told from the intercept by digits that the sums don't hold.
    """

    rounds: int = 30
    tol: float = 1e-10

    def fit(self, rows: DataFrame, features: list[str], label: str) -> LogisticFit:
        """The model of rows, each of which stands for __n equal ones."""
        n = F.col("__n")
        means = rows.agg(*[F.sum(n * F.col(c)) / F.sum(n) for c in features]).first()
        if means[0] is None:
            return LogisticFit(features, float("nan"), [float("nan")] * len(features))
        x = [F.lit(1.0), *[F.col(c) - F.lit(m) for c, m in zip(features, means, strict=True)]]
        size, b = len(x), np.zeros(len(features) + 1)
        upper = [(i, j) for i in range(size) for j in range(i, size)]
        for _ in range(self.rounds):
            p = 1 / (1 + F.exp(-sum((float(v) * c for v, c in zip(b[1:], x[1:], strict=True)), F.lit(float(b[0])))))
            each = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], "__n", (F.col(label).cast("double") - p).alias("g"), (p * (1 - p)).alias("w"))
            sums = [F.sum(n * F.col("g") * F.col(f"x{i}")) for i in range(size)] + [F.sum(n * F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in upper]
            sums = each.agg(*sums).first()
            h = np.zeros((size, size))
            for (i, j), v in zip(upper, sums[size:], strict=True):
                h[i, j] = h[j, i] = v
            unit = np.sqrt(np.where(np.diag(h) > 0, np.diag(h), 1.0))
            step = np.linalg.lstsq(h / np.outer(unit, unit), np.array(sums[:size]) / unit, rcond=1e-13)[0]
            b = b + step / unit
            # steps in units of the features' spread
            if np.max(np.abs(step)) < self.tol * unit[0]:
                break
        return LogisticFit(features, float(b[0] - sum(v * m for v, m in zip(b[1:], means, strict=True))), [float(v) for v in b[1:]])


@dataclass
class LogisticFit:
    """Intercept and slopes; transform adds the chance as __score."""

    features: list[str]
    intercept: float
    coefficients: list[float]

    def transform(self, rows: DataFrame) -> DataFrame:
        z = sum((F.lit(b) * F.col(c) for c, b in zip(self.features, self.coefficients, strict=True)), F.lit(self.intercept))
        return rows.withColumn("__score", 1 / (1 + F.exp(-z)))

    @property
    def stages(self) -> list[LogisticFit]:
        return [self]


def logistic(rounds: int = 30) -> Logistic:
    return Logistic(rounds)


def forest(trees: int = 30, depth: int = 5):
    return RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=SEED)


def boosted(rounds: int = 15, depth: int = 3):
    return GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=depth, seed=SEED)


def complete(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows with every feature."""
    return rows.dropna(subset=features)


def blocks(rows: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """rows with block: the square of the given size that each lies in."""
    return rows.withColumn("block", F.floor(F.col(x) / size) * 100_000 + F.floor(F.col(y) / size))


def block_folds(rows: DataFrame, k: int) -> DataFrame:
    """rows with fold: whole blocks, dealt from the largest to the smallest and back again over k folds."""
    order = Window.orderBy(F.col("n").desc(), "block")
    dealt = rows.groupBy("block").agg(F.count("*").alias("n")).withColumn("at", F.row_number().over(order) - 1)
    turn, place = F.floor(F.col("at") / k) % 2, F.col("at") % k
    return rows.join(dealt.select("block", F.when(turn == 0, place).otherwise(k - 1 - place).cast("int").alias("fold")), "block")


def _fit(rows: DataFrame, features: list[str], label: str, model):
    if isinstance(model, Logistic):
        return model.fit(rows if "__n" in rows.columns else rows.withColumn("__n", F.lit(1.0)), features, label)
    ready = rows.withColumn("__y", F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), model]).fit(ready)


def _counted(rows: DataFrame, columns: list[str], model) -> DataFrame:
    """What a model is fitted to: equal rows enter the sums of a regression once, with their number __n; trees draw rows, so
    they get each."""
    return cut(rows.groupBy(*columns).agg(F.count("*").cast("double").alias("__n"))) if isinstance(model, Logistic) else rows


def _scored(fitted, rows: DataFrame) -> DataFrame:
    out = fitted.transform(rows)
    out = out.withColumn("score", F.col("__score") if "__score" in out.columns else vector_to_array("probability")[1])
    return out.select(*rows.columns, "score")


def out_of_fold(rows: DataFrame, features: list[str], label: str, model, fold: str = "fold") -> DataFrame:
    """rows with score: each row's chance by the model fitted to the other folds. One fit a fold."""
    rows = cut(rows)
    names = sorted(r[0] for r in rows.select(fold).distinct().collect())
    done, known = None, _counted(rows, [fold, *features, label], model)
    for name in names:
        part = _scored(_fit(known.where(F.col(fold) != name), features, label, model), rows.where(F.col(fold) == name))
        done = part if done is None else done.unionByName(part)
    return rows.withColumn("score", F.lit(None).cast("double")) if done is None else done


def coefficients(rows: DataFrame, features: list[str], label: str, rounds: int = 30) -> dict[str, float]:
    """Intercept and slopes of a logistic model of all rows."""
    model = logistic(rounds)
    fitted = _fit(_counted(rows, [*features, label], model), features, label, model)
    return {"intercept": fitted.intercept} | dict(zip(features, fitted.coefficients, strict=True))


def shuffled(rows: DataFrame, key: str, column: str, by: str) -> DataFrame:
    """rows with the values of a column dealt anew among the rows of each group, by two hash orders of the key. Ranks
    come from ranges of hashes, so no task sorts a whole group. Rows of one key are numbered, so that each has its rank."""
    names = rows.columns
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(by, key).orderBy(column)))
    hashed = lambda salt: F.when(F.col("__k") == 1, F.xxhash64(F.col(key), F.lit(salt))).otherwise(F.xxhash64(F.col(key), F.col("__k"), F.lit(salt)))
    place = lambda salt: (hashed(salt) / F.lit(2.0**63)).alias("h")

    def ranked(salt: str, take: list) -> DataFrame:
        d = rows.select(by, key, "__k", place(f"{column}-{salt}"), *take)
        return d.join(value_ranks(d, by, "h").select(by, "h", "below"), [by, "h"]).drop("h")

    given, taken = ranked("from", [F.col(column).alias("__v")]).drop(key, "__k"), ranked("to", []).select(by, key, "__k", "below")
    return rows.drop(column).join(taken.join(given, [by, "below"]).select(by, key, "__k", F.col("__v").alias(column)), [by, key, "__k"]).select(*names)


def importance(rows: DataFrame, key: str, features: list[str], label: str, model, score, fold: str = "fold") -> DataFrame:
    """fold, feature, base, permuted, gain (impurity importance of the fold's model, where it has one): score is a function of
    a scored DataFrame that gives one number a fold; a column is shuffled within the held-out fold only.
    All folds are shuffled at once, and all their scores are judged in one pass."""
    rows = cut(rows)
    moved = [rows, *[cut(shuffled(rows, key, c, fold)) for c in features]]
    gains, parts = [], []
    for name in sorted(r[0] for r in rows.select(fold).distinct().collect()):
        fitted = _fit(rows.where(F.col(fold) != name), features, label, model)
        own = getattr(fitted.stages[-1], "featureImportances", None)
        gains += [(name, i + 1, c, float(own[i]) if own is not None else None) for i, c in enumerate(features)]
        parts += [_scored(fitted, d.where(F.col(fold) == name)).select(F.struct(fold, F.lit(i).alias("i")).alias(fold), label, "score") for i, d in enumerate(moved)]
    if not parts:
        return rows.select(fold, F.lit(None).cast("string").alias("feature"), *[F.lit(None).cast("double").alias(c) for c in ("base", "permuted", "gain")])
    # a group of scores is a fold with one column shuffled, or (0) with none
    each = cut(score(cut(reduce(DataFrame.unionByName, parts))).select(f"{fold}.*", "value"))
    base = each.where("i = 0").select(fold, F.col("value").alias("base"))
    known = rows.sparkSession.createDataFrame(gains, f"`{fold}` {rows.schema[fold].dataType.simpleString()}, i int, feature string, gain double")
    return base.join(each.withColumnRenamed("value", "permuted"), fold).join(F.broadcast(known), [fold, "i"]).select(fold, "feature", "base", "permuted", "gain")


def surface(rows: DataFrame, cells: DataFrame, features: list[str], label: str, model) -> DataFrame:
    """cells with score, spread (deviation of the trees' own chances) and outside (some feature lies beyond all training rows)."""
    fitted = _fit(rows, features, label, model)
    scored = _scored(fitted, cells)
    trees = fitted.stages[-1].trees
    each = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x")]).fit(cells).transform(scored)
    for k, tree in enumerate(trees):
        tree = tree.copy({tree.getParam("probabilityCol"): f"__p{k}", tree.getParam("rawPredictionCol"): f"__r{k}", tree.getParam("predictionCol"): f"__c{k}"})
        each = tree.transform(each).withColumn(f"__t{k}", vector_to_array(f"__p{k}")[1]).drop(f"__p{k}", f"__r{k}", f"__c{k}")
    chances = F.array(*[F.col(f"__t{k}") for k in range(len(trees))])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / len(trees)
    spread = F.sqrt(mean(F.transform(chances, lambda v: F.pow(v - mean(chances), F.lit(2)))))
    ends = rows.agg(*[f(c).alias(f"__{n}_{c}") for c in features for f, n in ((F.min, "lo"), (F.max, "hi"))])
    beyond = F.lit(False)
    for c in features:
        beyond = beyond | ~F.col(c).between(F.col(f"__lo_{c}"), F.col(f"__hi_{c}"))
    return each.withColumn("spread", spread).join(F.broadcast(ends)).withColumn("outside", beyond).select(*cells.columns, "score", "spread", "outside")


def partial_dependence(rows: DataFrame, features: list[str], label: str, model, feature: str, grid: list[float]) -> DataFrame:
    """feature value, mean score of all rows with that value in place of their own."""
    fitted = _fit(rows, features, label, model)
    # rows that agree in the other features have one score
    alike = rows.groupBy(*[c for c in features if c != feature]).agg(F.count("*").alias("__m"))
    at = alike.withColumn(feature, F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    return _scored(fitted, at).groupBy(F.col(feature).alias("value")).agg((F.sum(F.col("score") * F.col("__m")) / F.sum("__m")).alias("mean_score"), F.sum("__m").alias("n"))


def brier(score: Column, label: Column) -> Column:
    return F.avg(F.pow(score - label.cast("double"), F.lit(2)))
