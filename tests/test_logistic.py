"""The own Newton fit against a dense solver on the driver, and cross-validation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import logistic


def dense(x, y, ridge):
    x = np.column_stack([x, np.ones(len(x))])
    beta, pen = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-12), x.T @ (y - p) - pen * beta)
    return beta


def drawn(n=400, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (rng.random(n) < 1 / (1 + np.exp(-x @ rng.normal(size=d) - 0.3))).astype(int)
    return x, y


def frame(spark, x, y, fold=None):
    rows = [(i, [float(v) for v in r], int(t), int(fold[i]) if fold is not None else 0) for i, (r, t) in
            enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int, fold int").repartition(5)


def test_equals_a_dense_solver(spark):
    x, y = drawn()
    model = logistic.fit(frame(spark, x, y), "x", "y", ridge=0.5)
    assert np.allclose(model.coefficients[0], dense(x, y, 0.5), atol=1e-8)
    assert model.gradient < 1e-9 and (model.n, model.n_skipped) == (400, 0)


def test_all_folds_in_one_read_a_step(spark):
    x, y = drawn(seed=1)
    fold = np.arange(len(x)) % 4
    df = frame(spark, x, y, fold)
    model = logistic.fit(df, "x", "y", "fold", 4, ridge=1e-3)
    for k in range(4):
        assert np.allclose(model.coefficients[k], dense(x[fold != k], y[fold != k], 1e-3), atol=1e-7)
    got = {r.id: r.p for r in logistic.predict(df, model, "x", "fold").collect()}
    for i in range(0, 400, 37):
        z = x[i] @ model.coefficients[fold[i], :-1] + model.coefficients[fold[i], -1]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)))


def test_separable_rows_stay_finite(spark):
    x = np.array([[float(i)] for i in range(-20, 20)])
    model = logistic.fit(frame(spark, x, (x[:, 0] >= 0).astype(int)), "x", "y", ridge=1e-3)
    assert np.isfinite(model.coefficients).all() and model.loss[0] < 0.05


def test_odd_rows(spark):
    rows = [([1.0, 2.0], 1, 0), ([0.0, 1.0], 0, 1), ([2.0, 0.0], 1, 2), ([0.5, 0.5], 0, 0), ([1.0, None], 1, 0),
            ([float("nan"), 1.0], 1, 0), (None, 1, 0), ([1.0, 1.0], None, 0), ([1.0, 1.0], 2, 0), ([1.0, 1.0], 1, None),
            ([1.0, 1.0], 1, 7)]
    df = spark.createDataFrame(rows, "x array<double>, y int, fold int")
    model = logistic.fit(df, "x", "y", "fold", 3, ridge=1.0)
    assert (model.n, model.n_skipped) == (4, 7)
    scored = logistic.predict(df, model, "x", "fold")
    assert scored.filter("p IS NULL").count() == 4  # no vector, a null in it, no or an unknown fold
    assert logistic.fit(df.limit(0), "x", "y").n == 0
    with pytest.raises(ValueError, match="features"):
        logistic.fit(spark.createDataFrame([([1.0], 1), ([1.0, 2.0], 0)], "x array<double>, y int"), "x", "y")


def test_cross_validation_covers_every_row_once(spark):
    x, y = drawn(300, 3, 2)
    df = frame(spark, x, y).drop("fold").withColumn("p", F.lit("own"))
    scored, model = logistic.cross_validate(df.drop("p"), "x", "y", ["id"], 5)
    assert scored.count() == 300 and scored.filter("p IS NULL").count() == 0
    sizes = [r["count"] for r in scored.groupBy("fold").count().collect()]
    assert sizes == [60] * 5 and model.coefficients.shape == (5, 4)
    spread = {r.metric: r for r in logistic.metric_spread(logistic.fold_metrics(scored, "y")).collect()}
    assert spread["auc"].n_folds == 5 and 0.5 < spread["auc"].mean <= 1 and spread["accuracy"].std > 0
