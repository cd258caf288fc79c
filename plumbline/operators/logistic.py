"""Logistic regression by Newton's method, for one model or one per left-out fold.

A Newton step needs only sums over rows: the gradient, and the Gram matrix of the features
weighted by p (1 - p).  Every task adds up its own rows and returns one small record; these
are added in two levels, and only the last few reach the driver, where the step is solved.
Records grow with the square of the number of features, not with the rows.

For cross-validation all models go forward together: a row counts for every model but that
of its own fold, so each step reads the rows once, however many folds there are.  In the
first step all models weigh rows alike; sums per fold suffice there, and every model has
the total minus its own fold.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import as_col, let
from ..functions.scores import sigmoid
from ..functions.vectors import doubles
from .binary import auc
from .splits import fold_of

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Records that reach the driver in a step.
LAST = 8

#: Rows whose weighted features are in memory at a time.
SLICE = 4096


@dataclass(frozen=True)
class Fit:
    """Coefficients (models x features, the intercept last) and how they were reached.

    ``steps`` Newton steps were made; ``gradient`` is the largest mean slope left over and
    ``loss`` the mean log-loss of each model on its own rows; ``n`` rows took part in all and
    ``n_skipped`` did not."""

    coefficients: np.ndarray
    steps: int
    gradient: float
    loss: np.ndarray
    n: int
    n_skipped: int


def _usable(rows: DataFrame, features: str, label: str, fold: str | None, folds: int) -> DataFrame:
    """features, label, fold; null where a row cannot take part."""
    x, y = doubles(features), F.col(label).cast("double")
    fine = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))) & y.isin(0.0, 1.0)
    group = F.lit(-1) if fold is None else F.col(fold).cast("int")
    dealt = F.lit(True) if fold is None else F.coalesce(group.between(0, folds - 1), F.lit(False))
    return rows.select(F.when(fine & dealt, x).alias("x"), y.alias("y"), group.alias("f"))


def _sums(ready: DataFrame, betas: np.ndarray, whole: bool) -> np.ndarray:
    """Per model: Gram matrix, gradient, loss and rows, flattened.  ``whole`` sums the rows of
    each fold by itself, with the first model's coefficients; otherwise a row counts for all
    models but its own fold's."""
    models, width = betas.shape
    size = width * width + width + 2

    def add(out: np.ndarray, x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> None:
        z = x @ beta
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        out[:width * width] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        out[width * width:-2] += x.T @ (y - p)
        out[-2] += (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum()
        out[-1] += len(y)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((models, size))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                flat = part.column("x").flatten().to_numpy().reshape(part.num_rows, width - 1)
                x = np.column_stack([flat, np.ones(part.num_rows)])
                y, f = part.column("y").to_numpy(), part.column("f").to_numpy()
                for m in range(models):
                    mine = f == m if whole else f != m
                    if mine.any():
                        add(out[m], x[mine], y[mine], betas[0 if whole else m])
        yield _record(out)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((models, size))
        for batch in batches:
            for raw in batch.column("sums"):
                out += np.frombuffer(raw.as_buffer(), np.float64).reshape(models, size)
        yield _record(out)

    few = ready.mapInArrow(rows, "sums binary").repartition(LAST).mapInArrow(again, "sums binary")
    return sum((np.frombuffer(r.sums, np.float64) for r in few.collect()),
               np.zeros(models * size)).reshape(models, size)


def _record(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([sums.astype(np.float64).tobytes()], pa.binary())], ["sums"])


def fit(rows: DataFrame, features: str, label: str, fold: str | None = None, folds: int = 1,
        ridge: float = 1e-6, steps: int = 25, tolerance: float = 1e-9) -> Fit:
    """Fit P(label = 1) on an array column of features plus an intercept.

    With ``fold`` (0 to folds - 1) model i is fitted on all rows but those of fold i.
    ``ridge`` times half the squared coefficients, without the intercept, is added to the
    summed loss.  Steps that raise the loss are halved.  It ends when the mean slope is
    below ``tolerance`` or after ``steps`` steps.

    Rows with a null or non-finite feature, without such a fold, or with a label other than 0
    and 1 take no part and are counted.  All others must have equally many features.
    """
    models = folds if fold is not None else 1
    ready = _usable(rows, features, label, fold, folds)
    n, used, least, most = ready.agg(F.count("*"), F.count("x"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if used and least != most:
        raise ValueError(f"between {least} and {most} features")
    ready = ready.filter("x IS NOT NULL")
    width = (most or 0) + 1
    betas = np.zeros((models, width))
    penalty = np.append(np.full(width - 1, ridge), 0.0)
    kept, step_of, best = betas.copy(), np.zeros_like(betas), np.full(models, np.inf)
    made, slope, loss = 0, float("inf"), np.full(models, np.nan)
    for at in range(steps + 1):
        first = at == 0 and fold is not None
        sums = _sums(ready, betas, first)
        if first:
            sums = sums.sum(axis=0) - sums
        counts = np.maximum(sums[:, -1], 1)
        cost = sums[:, -2] + 0.5 * (penalty * betas ** 2).sum(axis=1)
        gradient = sums[:, width * width:-2] - penalty * betas
        worse = cost > best * (1 + 1e-12) + 1e-12
        loss = np.where(worse, loss, sums[:, -2] / counts)
        slope = float((np.abs(gradient).max(axis=1) / counts).max())
        if not used or at == steps or (slope < tolerance and not worse.any()):
            break
        grams = sums[:, :width * width].reshape(models, width, width) + np.diag(penalty + 1e-12)
        for m in range(models):
            if worse[m]:
                step_of[m] /= 2
            else:
                kept[m], best[m] = betas[m], cost[m]
                step_of[m] = np.linalg.lstsq(grams[m], gradient[m], rcond=None)[0]
        betas = kept + step_of
        made += 1
    return Fit(betas, made, slope, loss, int(used), int(n - used))


def _product(x: Column, beta: Column) -> Column:
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)


def predict(rows: DataFrame, model: Fit, features: str, fold: str | None = None, out: str = "p") -> DataFrame:
    """Add the probability of label 1: by the only model, or by that which left out the row's
    fold.  Null where a feature or the fold is missing."""
    each = F.array(*[F.array(*[F.lit(float(b)) for b in betas[:-1]]) for betas in model.coefficients])
    ends = F.array(*[F.lit(float(betas[-1])) for betas in model.coefficients])
    at = F.lit(0) if fold is None else F.col(fold).cast("int")
    x = F.when(F.size(features) == model.coefficients.shape[1] - 1, doubles(features))
    score = let(F.struct(x.alias("x"), F.get(each, at).alias("b"), F.get(ends, at).alias("e")),
                lambda s: _product(s["x"], s["b"]) + s["e"])
    return rows.withColumn(out, sigmoid(score))


def cross_validate(rows: DataFrame, features: str, label: str, ids: Sequence[str], folds: int = 10,
                   seed: int = 42, **params: float) -> tuple[DataFrame, Fit]:
    """Rows with their fold and the score of the model that has not seen that fold.

    Folds are equal slices of the seeded order of ``ids``.  ``params`` go to :func:`fit`.
    """
    dealt = fold_of(rows, ids, folds, seed)
    model = fit(dealt, features, label, "fold", folds, **params)
    return predict(dealt, model, features, "fold"), model


def fold_metrics(scored: DataFrame, label: str, p: str = "p", fold: str = "fold", threshold: float = 0.5) -> DataFrame:
    """One row per fold: n, accuracy, log_loss and auc of its out-of-fold scores.  Rows
    without score or label do not count."""
    ready = scored.filter(F.col(p).isNotNull() & F.col(label).isNotNull())
    hit = F.when(as_col(label) == 1, F.col(p)).otherwise(1 - F.col(p))
    flat = ready.groupBy(fold).agg(
        F.count("*").alias("n"), F.avg(((F.col(p) >= threshold) == (as_col(label) == 1)).cast("double")).alias("accuracy"),
        F.avg(-F.log(F.greatest(hit, F.lit(1e-15)))).alias("log_loss"))
    return flat.join(auc(ready, label, p, [fold]).select(fold, "auc"), fold, "left")


def metric_spread(metrics: DataFrame, names: Sequence[str] = ("accuracy", "log_loss", "auc")) -> DataFrame:
    """(metric, mean, std, n_folds): mean and sample deviation over folds."""
    sums = metrics.agg(*[e for m in names for e in (
        F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_n"))])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std"),
                              F.col(f"{m}_n").alias("n_folds")) for m in names])
    return sums.select(F.explode(rows).alias("r")).select("r.*")
