"""Models, regression, clusters, draws and late rows against brute force."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.operators import clusters, models, regression, sampling
from terralith.streaming.windows import run_in_turn


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(600):
        a, b, x, y = rng.normal(), rng.normal(), rng.random() * 100, rng.random() * 100
        rows.append((k, float(a), float(b), float(x), float(y), bool(rng.random() < 1 / (1 + math.exp(-2 * a)))))
    return spark.createDataFrame(rows, "id long, a double, b double, x double, y double, hit boolean").cache()


def test_no_block_is_split_and_folds_are_even(table):
    f = models.block_folds(models.blocks(table, "x", "y", 20.0), 5)
    assert f.groupBy("block").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r[1] for r in f.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 600 and max(sizes) < 1.35 * min(sizes)


def test_scores_are_out_of_fold(table):
    t = table.withColumn("fold", (F.col("id") % 3).cast("int"))
    got = models.out_of_fold(t, ["a", "b"], "hit", models.logistic()).collect()
    rows = table.orderBy("id").collect()
    x, y = np.array([[1.0, r["a"], r["b"]] for r in rows]), np.array([float(r["hit"]) for r in rows])
    for fold in range(3):
        use, b = np.arange(600) % 3 != fold, np.zeros(3)
        for _ in range(25):
            p = 1 / (1 + np.exp(-x[use] @ b))
            b = b + np.linalg.solve(x[use].T @ (x[use] * (p * (1 - p))[:, None]), x[use].T @ (y[use] - p))
        want = 1 / (1 + np.exp(-x @ b))
        assert max(abs(r["score"] - want[r["id"]]) for r in got if r["fold"] == fold) < 1e-6
    assert len(got) == 600


def test_a_shuffle_keeps_values_within_groups(table):
    t = table.withColumn("fold", (F.col("id") % 3).cast("int"))
    s = models.shuffled(t, "id", "a", "fold").cache()
    assert s.count() == 600 and sorted(s.columns) == sorted(t.columns)
    for fold in range(3):
        one, two = (sorted(r[0] for r in d.where(F.col("fold") == fold).select("a").collect()) for d in (t, s))
        assert one == two
    moved = s.join(table.select("id", F.col("a").alias("was")), "id").where("a <> was").count()
    assert moved > 550 and {tuple(r) for r in models.shuffled(t, "id", "a", "fold").select("id", "a").collect()} == {tuple(r) for r in s.select("id", "a").collect()}


def test_importance_tells_noise_from_signal(table):
    from terralith.operators import features

    t = table.withColumn("fold", (F.col("id") % 2).cast("int"))
    value = lambda s: features.auc(s, "fold", "score", "hit").select("fold", F.col("auc").alias("value"))
    got = models.importance(t, "id", ["a", "b"], "hit", models.forest(10), value).collect()
    loss = {(r["fold"], r["feature"]): r["base"] - r["permuted"] for r in got}
    assert len(got) == 4 and all(loss[k, "a"] > 0.15 and abs(loss[k, "b"]) < 0.08 for k in (0, 1))


def test_surface_flags_what_lies_beyond_training(spark, table):
    cells = spark.createDataFrame([(1, 0.1, 0.0), (2, 99.0, 0.0)], "cell int, a double, b double")
    got = {r["cell"]: r for r in models.surface(table, cells, ["a", "b"], "hit", models.forest(5)).collect()}
    assert not got[1]["outside"] and got[2]["outside"] and 0 <= got[1]["spread"] <= 0.5 and got[2]["score"] > got[1]["score"]


def test_regression_equals_normal_equations(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3)) * [1, 10, 0.1] + [1e6, 0, 5]
    y = x @ [0.5, -2, 30] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double")
    got = regression.fit(df, ["a", "b", "c"], "y")
    full = np.column_stack([np.ones(200), x - x.mean(0)])
    b = np.linalg.solve(full.T @ full, full.T @ y)
    s2 = ((y - full @ b) ** 2).sum() / 196
    se = np.sqrt(s2 * np.diag(np.linalg.inv(full.T @ full)))
    assert np.allclose(got["b"][1:], b[1:], rtol=1e-6) and np.allclose(got["se"][1:], se[1:], rtol=1e-6) and got["n"] == 200
    assert regression.two_sided_t(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and regression.two_sided_t(1.0, 1) == pytest.approx(0.5) and regression.two_sided_t(0.0, 5) == pytest.approx(1.0)
    assert math.isnan(regression.fit(df.limit(2), ["a", "b", "c"], "y")["b"][0])
    same = df.withColumn("d", F.col("b") * 2)
    assert math.isnan(regression.fit(same, ["b", "d"], "y")["b"][1])


def test_silhouette_equals_all_pairs(spark):
    rng = np.random.default_rng(9)
    z = np.vstack([rng.normal(size=(30, 2)), rng.normal(size=(25, 2)) + 6, [[40.0, 40.0]]])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(z)], "id int, u double, v double")
    centres = clusters.kmeans(df, ["u", "v"], [2, 3], 15)
    got = {r["k"]: r for r in clusters.sweep(df, ["u", "v"], centres).collect()}
    for k, c in centres.items():
        c = np.array(c)
        label = ((z[:, None] - c) ** 2).sum(-1).argmin(1)
        d2 = ((z[:, None] - z) ** 2).sum(-1)
        width = []
        for i, g in enumerate(label):
            own = (label == g) & (np.arange(len(z)) != i)
            others = [d2[i, label == h].mean() for h in set(label.tolist()) - {g}]
            width.append((min(others) - d2[i, own].mean()) / max(min(others), d2[i, own].mean()) if own.any() and others else 0.0)
        mean = np.array([z[label == h].mean(0) if (label == h).any() else c[h] for h in range(k)])
        assert got[k]["silhouette"] == pytest.approx(np.mean(width), abs=1e-9) and got[k]["inertia"] == pytest.approx(((z - mean[label]) ** 2).sum(), rel=1e-9)
    assert clusters.kmeans(df.where("false"), ["u", "v"], [2]) == {2: []}


def test_draws_fall_by_weight(spark):
    rows = [(k, None if k == 7 else float((k * 37) % 11)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, w double")
    summed = sampling.prefix_sums(df, "id", "w", 16)
    upto = np.cumsum([w or 0 for _, w in rows])
    assert all(r["upto"] == upto[r["id"]] and r["before"] == upto[r["id"]] - (rows[r["id"]][1] or 0) for r in summed.collect())
    u = [(i + 0.5) / 777 for i in range(777)]
    got = {r["n"]: r["id"] for r in sampling.drawn(summed, spark.createDataFrame(list(enumerate(u)), "n int, u double"), 64).collect()}
    assert got == {i: int(np.searchsorted(upto, v * upto[-1], "right")) for i, v in enumerate(u)}


def test_rows_later_than_the_watermark_are_dropped(spark):
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    batches = [[(1, at(1, 5), "a", 1.0), (2, at(3, 5), "a", 1.0)], [(3, at(1, 9), "a", 1.0), (4, at(3, 1), "a", 1.0), (5, at(6, 5), "a", 1.0)], [(6, at(3, 2), "a", 1.0), (7, at(9, 5), "a", 1.0)]]
    out = run_in_turn(spark, [spark.createDataFrame(b, schema) for b in batches])
    # the first day closed after the first batch, the third one after the second
    assert sorted((r["day"].day, r["n"]) for r in out.collect()) == [(1, 1), (3, 2), (6, 1)]


def test_rows_that_repeat_a_key_meet_once(spark, tmp_path):
    """Training rows, neighbours and shuffles grow with the rows, not with the square of a key's copies."""
    from terralith.operators import inference
    from terralith.plans import predictive

    sf = "/root/testdata/sf0.001"
    for name in ("customer", "supplier", "orders"):
        t = spark.read.parquet(f"{sf}/{name}.parquet")
        (t.unionByName(t).unionByName(t) if name == "customer" else t).write.parquet(f"{tmp_path}/{name}.parquet")
    one, three = predictive.training(spark, sf), predictive.training(spark, str(tmp_path))
    assert three.count() == 3 * one.count() > 0 and three.distinct().count() == one.count()
    edges = lambda t: sorted(map(tuple, inference.nearest_weights(t, "pid", 4, 2000.0).collect()))
    assert edges(one) == edges(three)
    held = three.withColumn("fold", F.lit(0))
    moved = models.shuffled(held, "pid", "x1", "fold")
    assert moved.count() == held.count() and sorted(r[0] for r in moved.select("x1").collect()) == sorted(r[0] for r in held.select("x1").collect())


def test_equal_rows_enter_a_regression_with_their_number(table):
    few = table.withColumn("a", F.round("a", 0)).withColumn("b", F.round("b", 0))
    counted = models._counted(few, ["a", "b", "hit"], models.logistic())
    assert counted.count() < 100 and counted.agg(F.sum("__n")).first()[0] == 600
    got = models.coefficients(few, ["a", "b"], "hit")
    rows = few.collect()
    x, y, b = np.array([[1.0, r["a"], r["b"]] for r in rows]), np.array([float(r["hit"]) for r in rows]), np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    assert np.allclose(list(got.values()), b, atol=1e-8)


def test_logistic_model_of_a_feature_that_hardly_varies(spark):
    rng = np.random.default_rng(7)
    u = rng.integers(0, 60, 4000) ** 2 / 80000
    x = np.column_stack([np.ones(4000), rng.integers(-6, 8, 4000) / 50, -1.98 + u / 1000])
    hit = rng.random(4000) < 1 / (1 + np.exp(-(1.5 - 0.1 * x[:, 1] + 8 * (u - 0.015))))
    rows = [(k, int(k % 5), float(a), float(b), bool(h)) for k, (a, b, h) in enumerate(zip(x[:, 1], x[:, 2], hit, strict=True))]
    t = spark.createDataFrame(rows, "id long, fold int, a double, b double, hit boolean")

    def fitted(use):
        z, b = x - [0, *x[:, 1:].mean(axis=0)], np.zeros(3)
        for _ in range(15):
            p = 1 / (1 + np.exp(-z[use] @ b))
            b = b + np.linalg.solve(z[use].T @ (z[use] * (p * (1 - p))[:, None]), z[use].T @ (hit[use] - p))
        return np.array([b[0] - b[1:] @ x[:, 1:].mean(axis=0), b[1], b[2]])

    want = fitted(np.ones(4000, bool))
    got = models.coefficients(t, ["a", "b"], "hit")
    assert np.allclose([got["intercept"], got["a"], got["b"]], want, rtol=1e-8, atol=0)
    by_fold = [fitted(np.arange(4000) % 5 != f) for f in range(5)]
    scores = models.out_of_fold(t, ["a", "b"], "hit", models.logistic()).collect()
    assert max(abs(r["score"] - 1 / (1 + math.exp(-x[r["id"]] @ by_fold[r["fold"]]))) for r in scores) < 1e-9


def test_logistic_model_of_one_value_and_of_no_rows(spark):
    t = spark.createDataFrame([(1.0, 5.0, True), (2.0, 5.0, False), (3.0, 5.0, True), (4.0, 5.0, True)], "a double, b double, hit boolean")
    alone, both = models.coefficients(t, ["a"], "hit"), models.coefficients(t, ["a", "b"], "hit")
    assert math.isclose(alone["a"], both["a"]) and math.isclose(alone["intercept"], both["intercept"] + 5 * both["b"])
    assert all(math.isnan(v) for v in models.coefficients(t.where("a > 9"), ["a"], "hit").values())
