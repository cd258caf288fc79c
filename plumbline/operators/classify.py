"""Multi-class evaluation from one small aggregate: the confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import log_sum_exp

F1_GUARD = 1e-8


def _class_of(col: str, classes: int) -> Column:
    """The class number; a value that is none, NULL included, stops the query."""
    c = F.col(col).cast("int")
    said = F.concat(F.lit(f"{col} is no class of 0 to {classes - 1}: "),
                    F.coalesce(F.col(col).cast("string"), F.lit("NULL")))
    return F.when(c.between(0, classes - 1), c).otherwise(F.raise_error(said).cast("int"))


def count_outside(df: DataFrame, y: str, pred: str, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose label or prediction is no class, beside all rows: what to look at, or to
    filter on purpose, before the figures below, which refuse such rows."""
    inside = F.coalesce(F.col(y).between(0, classes - 1) & F.col(pred).between(0, classes - 1), F.lit(False))
    return df.groupBy(*by).agg(F.count_if(~inside).alias("n_outside"), F.count("*").alias("n"))


def _cells(df: DataFrame, y: str, pred: str, classes: int, by: Sequence[str]) -> DataFrame:
    """Row counts per pair of classes."""
    return df.groupBy(*by, _class_of(y, classes).alias("y"), _class_of(pred, classes).alias("pred")
                      ).agg(F.count("*").alias("n"))


def _with_classes(keys: DataFrame, classes: int, name: str) -> DataFrame:
    return keys.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))


def _groups(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct evaluation groups (one empty row when there are no group columns)."""
    return cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()


def confusion(df: DataFrame, y: str, pred: str, classes: int, by: Sequence[str] = (),
              normalize: bool = False) -> DataFrame:
    """All ``classes`` x ``classes`` cells (rows true, columns predicted), zeros included."""
    cells = _cells(df, y, pred, classes, by)
    grid = _with_classes(_with_classes(_groups(cells, by), classes, "y"), classes, "pred")
    full = (grid.join(cells, [*by, "y", "pred"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))))
    if not normalize:
        return full
    rows = full.groupBy(*by, "y").agg(F.greatest(F.sum("n"), F.lit(1)).alias("_t"))
    return full.join(rows, [*by, "y"]).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def accuracy(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("acc"),
                               F.count("*").alias("n"))


def guarded_f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(F1_GUARD))


def per_class_prf(df: DataFrame, y: str, pred: str, classes: int,
                  by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class, also of unseen ones."""
    cells = _cells(df, y, pred, classes, by)
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), zero.alias("predicted"),
                 hit.alias("tp")),
        F.struct(F.col("pred").alias("class"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("tp")))
    sums = (cells.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
            .groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]))
    full = (_with_classes(_groups(cells, by), classes, "class").join(sums, [*by, "class"], "left")
            .na.fill(0, ["support", "predicted", "tp"]))
    one = F.lit(1)
    precision = F.col("tp") / F.greatest(F.col("predicted"), one)
    recall = F.col("tp") / F.greatest(F.col("support"), one)
    return (full.withColumn("precision", precision).withColumn("recall", recall)
            .withColumn("f1", guarded_f1(F.col("precision"), F.col("recall")))
            .select(*by, "class", "precision", "recall", "f1", "support"))


def f1_scores(df: DataFrame, y: str, pred: str, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted F1 (0 without rows), macro F1 over all classes, accuracy, n."""
    prf = per_class_prf(df, y, pred, classes, by)
    n = F.sum("support")
    return prf.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), n), F.lit(0.0))
        .alias("weighted_f1"),
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("recall") * F.col("support")), n), F.lit(0.0)).alias("acc"),
        F.coalesce(n, F.lit(0)).alias("n"))


def per_class_accuracy(df: DataFrame, y: str, pred: str, classes: int,
                       by: Sequence[str] = ()) -> DataFrame:
    """Recall of every class with its row count, shown as at least 1."""
    return per_class_prf(df, y, pred, classes, by).select(
        *by, "class", F.col("recall").alias("acc"),
        F.greatest(F.col("support"), F.lit(1)).alias("n"))


def summary(df: DataFrame, y: str, pred: str, classes: int, by: Sequence[str],
            expected: DataFrame | None = None) -> DataFrame:
    """Accuracy %, weighted F1 and row count per model and dataset.

    Groups that are expected but have no rows keep NULL figures and n = 0.
    """
    scored = f1_scores(df, y, pred, classes, by).select(
        *by, (F.col("acc") * 100).alias("acc_pct"), "weighted_f1", "n")
    if expected is None:
        return scored
    return expected.select(*by).distinct().join(scored, list(by), "left").na.fill(0, ["n"])


def cross_entropy(df: DataFrame, y: str, logits: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean multi-class loss from raw class scores over the ``n`` rows that have one.

    Rows whose label lies outside the scores, or that hold NULL, have no loss.
    """
    loss = log_sum_exp(logits) - F.get(F.col(logits), F.col(y)).cast("double")
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"), F.count(loss).alias("n"))
