"""Binary evaluation: thresholded counts, exact ROC-AUC, ROC points, subgroup tables.

AUC and ROC need scores in order.  Scores are first reduced to counts per distinct
value, in one pass over the rows; that table is stored, counted, and cut into value
ranges at approximate quantiles when it is large.  Ranges only balance the work:
counts in front of a range come from a small table of range totals, so the result
is exact wherever the cuts fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import GENUINE
from ..functions.scores import THRESHOLD, at_least
from ..session import stored
from .classify import guarded_f1

#: Distinct scores per value range, and the largest number of ranges.
RANGE_ROWS = 500_000
MAX_RANGES = 10_000


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    one = F.lit(1)
    precision = tp / F.greatest(tp + fp, one)
    recall = tp / F.greatest(tp + fn, one)
    return [precision.alias("precision"), recall.alias("recall"),
            guarded_f1(precision, recall).alias("f1")]


def _outcomes(y: Column, p: Column, threshold: float) -> list[Column]:
    hit = at_least(p, threshold)
    return [F.count_if(hit & (y == 1)).alias("tp"), F.count_if(~hit & (y == 0)).alias("tn"),
            F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn")]


def _rates() -> list[Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    return [n.alias("n"), ((tp + tn) / F.greatest(n, F.lit(1))).alias("acc"), *_prf(tp, fp, fn)]


def binary_metrics(df: DataFrame, y: str, p: str, threshold: float = THRESHOLD,
                   by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and the four counts, in one aggregation."""
    counts = df.groupBy(*by).agg(*_outcomes(F.col(y), F.col(p), threshold))
    return counts.select(*by, "tp", "tn", "fp", "fn", *_rates())


# -- ordered scores ----------------------------------------------------------------

def _ranges(counts: DataFrame, range_rows: int) -> Bucketizer:
    """Value ranges of about ``range_rows`` rows each of a stored count table."""
    n = min(MAX_RANGES, -(-counts.count() // range_rows))
    inner: set[float] = set()
    if n > 1:
        cuts = counts.approxQuantile("p", [i / n for i in range(1, n)], 0.5 / n)
        inner = {c for c in cuts if c == c and abs(c) != float("inf")}
    splits = [float("-inf"), *sorted(inner or {0.0}), float("inf")]
    return Bucketizer(splits=splits, inputCol="p", outputCol="range", handleInvalid="keep")


def _ranged(counts: DataFrame, cutter: Bucketizer) -> DataFrame:
    return cutter.transform(counts).withColumn("range", F.col("range").cast("int"))


def _score_counts(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score (``-0.0`` counts as ``0.0``)."""
    score = F.col(p).cast("double") + F.lit(0.0)
    return stored(df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
                  .groupBy(*by, score.alias("p"))
                  .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")))


def count_unscored(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group the rows that the score tables leave out: without score, without label, in all."""
    no_p, no_y = F.col(p).isNull(), F.col(y).isNull()
    return df.groupBy(*by).agg(F.count_if(no_p).alias("n_no_score"), F.count_if(no_y).alias("n_no_label"),
                               F.count_if(no_p | no_y).alias("n_dropped"), F.count(F.lit(1)).alias("n"))


def _wins(counts: DataFrame, pool: Sequence[str], kind: Sequence[str], cutter: Bucketizer,
          extra: Sequence[str] = ()) -> DataFrame:
    """Per (pool, kind): won pairs of the kind's positives against the pool's negatives.

    The negatives of a pool are shared by all of its kinds through one running count,
    so nothing is replicated.  Rows of equal score are peers: half of the negatives
    at the same score count as won.
    """
    ranged = _ranged(counts, cutter)
    scored = W.partitionBy(*pool, "range").orderBy("p")
    level = F.sum("neg").over(scored.rangeBetween(W.currentRow, W.currentRow))
    below = F.sum("neg").over(scored).cast("double") - level / 2
    inside = (ranged.withColumn("_in", F.col("pos").cast("double") * below)
              .groupBy(*pool, *kind, "range")
              .agg(F.sum("_in").alias("_in"),
                   *[F.sum(c).alias(c) for c in ("pos", "neg", *extra)]))
    # At most one row per range and kind from here on.
    by_range = W.partitionBy(*_constant(pool)).orderBy("range")
    own = F.sum("neg").over(by_range.rangeBetween(W.currentRow, W.currentRow))
    through = F.sum("neg").over(by_range)
    won = inside.withColumn(
        "_won", F.col("_in") + F.col("pos").cast("double") * (through - own).cast("double"))
    return won.groupBy(*pool, *kind).agg(
        F.sum("_won").alias("_won"), *[F.sum(c).alias(c) for c in ("pos", "neg", *extra)])


def _constant(cols: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in cols] or [F.lit(0)]


def _auc(won: Column, pos: Column, neg: Column) -> Column:
    return F.try_divide(won, pos.cast("double") * neg.cast("double"))


def auc(df: DataFrame, y: str, p: str, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """ROC-AUC per group; ties count half, NULL when a group has one class only."""
    counts = _score_counts(df, y, p, by)
    won = _wins(counts, by, [], _ranges(counts, range_rows))
    return won.select(*by, _auc(F.col("_won"), F.col("pos"), F.col("neg")).alias("auc"),
                      F.col("pos").alias("n_pos"), F.col("neg").alias("n_neg"))


def roc_points(df: DataFrame, y: str, p: str, by: Sequence[str] = (),
               range_rows: int = RANGE_ROWS) -> DataFrame:
    """(fpr, tpr) at every distinct score taken as threshold, plus the origin, whose
    threshold is NULL."""
    counts = _score_counts(df, y, p, by)
    return _roc_of_counts(counts, by, _ranges(counts, range_rows))


def _roc_of_counts(counts: DataFrame, by: Sequence[str], cutter: Bucketizer) -> DataFrame:
    ranged = _ranged(counts, cutter)
    totals = ranged.groupBy(*by, "range").agg(F.sum("pos").alias("_rp"), F.sum("neg").alias("_rn"))
    whole = W.partitionBy(*_constant(by))
    above = whole.orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "range",
        F.coalesce(F.sum("_rp").over(above), F.lit(0)).alias("_ap"),
        F.coalesce(F.sum("_rn").over(above), F.lit(0)).alias("_an"),
        F.sum("_rp").over(whole).alias("_p"), F.sum("_rn").over(whole).alias("_n"),
        F.row_number().over(whole.orderBy(F.desc("range"))).alias("_first"))
    inner = W.partitionBy(*by, "range").orderBy(F.desc("p"))
    points = (ranged.withColumn("_cp", F.sum("pos").over(inner))
              .withColumn("_cn", F.sum("neg").over(inner))
              .join(offsets, [*by, "range"])
              .select(*by, F.col("p").alias("threshold"),
                      F.try_divide(F.col("_cn") + F.col("_an"), F.col("_n")).alias("fpr"),
                      F.try_divide(F.col("_cp") + F.col("_ap"), F.col("_p")).alias("tpr")))
    origin = offsets.filter("_first = 1").select(
        *by, F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


# -- subgroups -----------------------------------------------------------------------

def one_vs_reference(df: DataFrame, dataset: str, kind: str, y: str, p: str,
                     reference: str = GENUINE, threshold: float = THRESHOLD,
                     range_rows: int = RANGE_ROWS) -> DataFrame:
    """Subgroup table: every forged kind against its dataset's genuine rows.

    The reference kind's own row holds only the share of scores below the threshold.
    A last row ``OVERALL / all pairs`` scores all rows once.
    """
    scores = _score_counts(df, y, p, [dataset, kind])
    cutter = _ranges(scores, range_rows)
    hit, zero = F.col("p") >= F.lit(threshold), F.lit(0).cast("bigint")
    tagged = scores.select(
        dataset, kind, "p", "pos", "neg",
        F.when(hit, F.col("pos")).otherwise(zero).alias("tp"),
        F.when(hit, F.col("neg")).otherwise(zero).alias("fp"))
    whole = tagged.withColumn(dataset, F.lit("OVERALL")).withColumn(kind, F.lit("all pairs"))
    won = _wins(tagged.unionByName(whole), [dataset], [kind], cutter, ["tp", "fp"])

    # One row per (dataset, kind): the rest is arithmetic on totals.
    pool = W.partitionBy(dataset)
    n_ref, fp_ref = F.sum("neg").over(pool), F.sum("fp").over(pool)
    is_ref = F.col(kind) == reference
    table = won.select(
        dataset, kind, is_ref.alias("_ref"), (F.col("pos") + F.col("neg")).alias("_own"),
        (F.col("pos") + F.col("neg") - F.col("tp") - F.col("fp")).alias("_low"),
        "tp", fp_ref.alias("fp"), (n_ref - fp_ref).alias("tn"),
        (F.col("pos") - F.col("tp")).alias("fn"),
        _auc(F.col("_won"), F.col("pos"), n_ref).alias("_auc"))
    rates = dict(zip(("n", "acc", "precision", "recall", "f1"), _rates(), strict=True))

    def unless_ref(value: Column, other: Column | None = None) -> Column:
        plain = F.when(~F.col("_ref"), value)
        return plain if other is None else plain.otherwise(other)

    return table.select(
        dataset, kind, unless_ref(rates["n"], F.col("_own")).alias("n"),
        unless_ref(rates["acc"], F.col("_low") / F.col("_own")).alias("acc"),
        *[unless_ref(rates[c]).alias(c) for c in ("precision", "recall", "f1")],
        unless_ref(F.col("_auc")).alias("auc"))


def roc_by_kind(df: DataFrame, kind: str, y: str, p: str, reference: str = GENUINE,
                range_rows: int = RANGE_ROWS) -> DataFrame:
    """ROC points of every forged kind against all genuine rows, and over all rows.

    Every curve has a point at each genuine score, so here the genuine counts are
    replicated, after they were reduced to distinct scores.
    """
    scores = _score_counts(df, y, p, [kind])
    cutter = _ranges(scores, range_rows)
    zero = F.lit(0).cast("bigint")
    kinds = scores.filter(F.col(kind) != reference).agg(F.sort_array(F.collect_set(kind)).alias("_k"))
    ref = scores.filter("neg > 0").select("p", zero.alias("pos"), "neg")
    names = kinds.scalar()
    shared = ref.withColumn(kind, F.explode(names))
    own = scores.filter((F.col(kind) != reference) & (F.col("pos") > 0)).withColumn("neg", zero)
    every = scores.withColumn(kind, F.lit("all pairs"))
    curves = shared.unionByName(own).unionByName(every)
    merged = curves.groupBy(kind, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _roc_of_counts(merged, [kind], cutter)


def confusion_by(df: DataFrame, by: str, p: str, threshold: float = THRESHOLD) -> DataFrame:
    """Rows predicted genuine / forged per kind, with the row-normalised shares."""
    hit = at_least(p, threshold)
    out = df.groupBy(by).agg(F.count_if(~hit).alias("pred_genuine"), F.count_if(hit).alias("pred_fake"))
    n = F.greatest(F.col("pred_genuine") + F.col("pred_fake"), F.lit(1))
    return out.withColumn("share_genuine", F.col("pred_genuine") / n).withColumn(
        "share_fake", F.col("pred_fake") / n)


def log_loss(df: DataFrame, y: str, logit: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean binary loss from logits, stable for large values, over the ``n`` rows that have
    a label and a logit."""
    x = F.col(logit).cast("double")
    loss = F.greatest(x, F.lit(0.0)) - x * F.col(y) + F.log1p(F.exp(-F.abs(x)))
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"), F.count(loss).alias("n"))
