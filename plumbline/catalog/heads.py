"""Queries that fit a head, each against the same Newton steps spelt out in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vectors import fuse
from ..operators import logistic
from . import frames
from .registry import query

RIDGE, STEPS, FOLDS = 1e-6, 8, 3


def _newton_sql(rows: str, models: str, width: int, steps: int = STEPS) -> str:
    """CTEs b0, b1, ... of the coefficients per model ``m`` after each step.  ``rows`` has
    x0.., y and f; a row counts for every model but f.  The symmetric system is solved by
    elimination without exchanges and back-substitution."""
    n = width + 1
    every = range(n)
    out = [f"b0 AS MATERIALIZED (SELECT m, {', '.join(f'0.0::DOUBLE AS b{i}' for i in every)} FROM {models})"]
    for s in range(steps):
        z = " + ".join([*[f"b{i} * x{i}" for i in range(width)], f"b{width}"])
        out.append(f"p{s} AS MATERIALIZED (SELECT b.*, r.* EXCLUDE (f), 1.0::DOUBLE AS x{width}, 1 / (1 + exp(-({z}))) AS p "
                   f"FROM {rows} r JOIN b{s} b ON r.f <> b.m)")
        sums = [f"sum(p * (1 - p) * x{i} * x{j}){f' + {RIDGE}' if i == j < width else ''} AS a{i}_{j}"
                for i in every for j in every if i <= j]
        sums += [f"sum(x{i} * (y - p)){f' - {RIDGE} * any_value(b{i})' if i < width else ''} AS r{i}" for i in every]
        sums += [f"any_value(b{i}) AS b{i}" for i in every]
        out.append(f"e{s}_0 AS MATERIALIZED (SELECT m, {', '.join(sums)} FROM p{s} GROUP BY m)")
        for k in range(n - 1):
            less = [f"a{i}_{j} - a{k}_{i} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" for i in range(k + 1, n) for j in range(i, n)]
            less += [f"r{i} - a{k}_{i} / a{k}_{k} * r{k} AS r{i}" for i in range(k + 1, n)]
            out.append(f"e{s}_{k + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(less)}) FROM e{s}_{k})")
        inner = f"SELECT *, r{width} / a{width}_{width} AS d{width} FROM e{s}_{n - 1}"
        for i in reversed(range(width)):
            known = " - ".join([f"r{i}", *[f"a{i}_{j} * d{j}" for j in range(i + 1, n)]])
            inner = f"SELECT *, ({known}) / a{i}_{i} AS d{i} FROM ({inner})"
        out.append(f"b{s + 1} AS MATERIALIZED (SELECT m, {', '.join(f'b{i} + d{i} AS b{i}' for i in every)} FROM ({inner}))")
    return ", ".join(out)


#: The fused pair of the first dimension of either half.
_ROWS = """h AS (SELECT vec_id, embedding[1]::DOUBLE AS x0, embedding[33]::DOUBLE AS x1,
    abs(embedding[1]::DOUBLE - embedding[33]::DOUBLE) AS x2, embedding[1]::DOUBLE * embedding[33]::DOUBLE AS x3,
    (label >= 5)::INTEGER AS y, vec_id % 5 = 0 AS held FROM embeddings)"""
_SCORE = "1 / (1 + exp(-(b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3 + b4)))"
_SINGLE = f"""{_ROWS}, r AS (SELECT x0, x1, x2, x3, y, 0 AS f FROM h WHERE NOT held), one AS (SELECT -1 AS m),
  {_newton_sql('r', 'one', 4)}"""
_FOLDED = f"""{_ROWS}, k AS (SELECT *, count(*) OVER () AS n,
    row_number() OVER (ORDER BY md5(concat_ws(':', vec_id, '42')), vec_id) AS rk FROM h),
  g AS (SELECT *, (SELECT count(*) FROM range(1, {FOLDS}) t(i) WHERE rk > floor(n * i / {FOLDS}.0::DOUBLE))::INTEGER AS f FROM k),
  r AS (SELECT x0, x1, x2, x3, y, f FROM g), models AS (SELECT DISTINCT f AS m FROM g),
  {_newton_sql('r', 'models', 4)},
  o AS (SELECT g.vec_id, g.f AS fold, g.y, {_SCORE} AS p FROM g JOIN b{STEPS} b ON g.f = b.m)"""


def _rows(spark, sf):
    first: list[Column] = [F.slice(c, 1, 1) for c in ("a", "b")]
    return frames.vectors(spark, sf).select(
        "vec_id", fuse(*first).alias("x"), (F.col("label") >= 5).cast("int").alias("y"),
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("part"))


def _fitted(spark, sf):
    rows = _rows(spark, sf)
    return rows, logistic.fit(rows.filter("part = 'train'"), "x", "y", ridge=RIDGE)


@query("fit_head", f"""WITH {_SINGLE} SELECT vec_id, CASE WHEN held THEN 'test' ELSE 'train' END AS part, y,
  round({_SCORE}, 6) AS p FROM h, b{STEPS}""")
def _(spark, sf):
    """Scores of all rows by a head that was fitted on the training rows."""
    rows, model = _fitted(spark, sf)
    return frames.rounded(logistic.predict(rows, model, "x"), "p").select("vec_id", "part", "y", "p")


@query("head_coefficients", f"""WITH {_SINGLE} SELECT unnest(range(5))::INTEGER AS pos,
  unnest([round(b0, 6), round(b1, 6), round(b2, 6), round(b3, 6), round(b4, 6)]) AS value FROM b{STEPS}""")
def _(spark, sf):
    _, model = _fitted(spark, sf)
    return spark.createDataFrame([(i, round(float(b), 6)) for i, b in enumerate(model.coefficients[0])], "pos int, value double")


def _validated(spark, sf):
    return logistic.cross_validate(_rows(spark, sf), "x", "y", ["vec_id"], FOLDS, ridge=RIDGE)[0]


@query("cross_validate", f"WITH {_FOLDED} SELECT vec_id, fold, y, round(p, 6) AS p FROM o")
def _(spark, sf):
    """Every row scored by the model that left out its fold."""
    return frames.rounded(_validated(spark, sf), "p").select("vec_id", "fold", "y", "p")


@query("fold_spread", f"""WITH {_FOLDED},
  u AS (SELECT a.fold, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc
        FROM o a JOIN o b ON a.fold = b.fold AND a.y = 1 AND b.y = 0 GROUP BY a.fold),
  f AS (SELECT o.fold, avg(((p >= 0.5) = (y = 1))::INTEGER) AS accuracy,
          avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS log_loss, any_value(auc) AS auc
        FROM o JOIN u ON o.fold = u.fold GROUP BY o.fold)
  SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*)::BIGINT AS n_folds
  FROM (SELECT unnest(['accuracy', 'log_loss', 'auc']) AS metric, unnest([accuracy, log_loss, auc]) AS v FROM f) GROUP BY metric""")
def _(spark, sf):
    """Mean and deviation of the metrics over the folds."""
    spread = logistic.metric_spread(logistic.fold_metrics(_validated(spark, sf), "y"))
    return frames.rounded(frames.rounded(spread, "mean"), "std")
