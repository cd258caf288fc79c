"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training progress 0 to 1, piecewise linear
between knots.  Its integral is the source's weight.  The weights share a word budget;
no source gets more than ``max_repeats`` times its size, and what is cut off is shared
anew by weight.  A source's cumulative demand at progress t is its target times the
integral of its schedule up to t over the whole integral.  Documents of a source stand in
a seeded order, repeated if the target asks for it; the demand curve is inverted at the
place of every document, which gives its training position.  Sorting all documents by
position yields the training order.

The place of a document is a cumulative sum over its source.  It is computed in two
levels, so that no source has to fit one task: sums per (source, hash bucket), running
sums over the buckets, and a running sum inside each small bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import ranked
from ..session import join_summary, stored
from .common import n_words

#: A schedule: (progress, weight) knots with rising progress from 0 to 1.
Schedule = Sequence[tuple[float, float]]

#: Weights 5, 2 and 1 in turn, as a curriculum: large sources fade, small ones ramp up.
FADE_AND_RAMP: tuple[Schedule, ...] = (
    ((0.0, 6.0), (0.5, 5.0), (1.0, 4.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix."""

    schedules: tuple[Schedule, ...] = FADE_AND_RAMP
    budget: float = 1.5
    max_repeats: int = 2
    seed: int = 7
    bucket_rows: int = 4096


def integral(schedule: Schedule) -> float:
    """The area under a schedule: the weight of its source."""
    return sum((t1 - t0) * (w0 + w1) / 2
               for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def progress_at(share: Column, schedule: Schedule) -> Column:
    """The progress at which ``share`` of a schedule's integral is reached."""
    total, done = integral(schedule), 0.0
    need = share * total
    out = F.lit(schedule[-1][0])
    steps = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        slope = (w1 - w0) / (t1 - t0)
        left = F.greatest(need - done, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * left, F.lit(0.0)))
        at = F.lit(t0) + F.coalesce(F.try_divide(2 * left, F.lit(w0) + root), F.lit(0.0))
        done += area
        steps.append((done, F.least(at, F.lit(t1))))
    for limit, at in reversed(steps):
        out = F.when(need <= limit, at).otherwise(out)
    return out


def _positions(shares: Column, schedule: Schedule) -> Column:
    return F.transform(shares, lambda x: progress_at(x, schedule))


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Weight class and target of every source, from (source, source_size).

    Sources are numbered by code point with null last and take the schedules in turn.
    The shared budget is ``mix.budget`` times all words.  The level at which uncapped
    sources stand per unit of weight is raised until no source is above its cap; each
    round is one aggregation over the sources, and only its two sums come to the driver.
    """
    kinds = len(mix.schedules)
    weights = F.array(*[F.lit(float(integral(s))) for s in mix.schedules])
    numbered = ranked(sizes.withColumn("last", F.col("source").isNull()), [], ["last", "source"], "rank")
    rows = stored(numbered.select(
        "source", "source_size", F.pmod(F.col("rank") - 1, F.lit(kinds)).cast("int").alias("kind"))
        .withColumn("weight", F.get(weights, "kind"))
        .withColumn("cap", mix.max_repeats * F.col("source_size")))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * mix.budget
    level = 0.0
    while True:
        over = F.col("cap") < level * F.col("weight")
        capped, weight = rows.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)),
                                  F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        raised = max(0.0, total - (capped or 0)) / weight
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return rows.select("source", "source_size", "kind", target.alias("target"))


def assign_positions(docs: DataFrame, mix: Mix = Mix(), keep: Sequence[str] | None = None) -> DataFrame:  # noqa: B008
    """Give every document its copies and their training positions, one row per document.

    Returns the ``keep`` columns of ``docs`` (all by default) followed by mix_key,
    mix_size, mix_source_size, mix_target, mix_copies and mix_positions (one progress
    value from 0 to 1 per copy).  A copy is taken when more than half of it lies within
    the target, so a source misses its target by half a document at most.

    A null text has no words.  A document without words takes part once, and costs
    nothing.  A null source is a source of its own, the last one.  Repeated rows are
    documents of their own; their order among themselves does not matter.  Columns of
    ``docs`` may have any names but those beginning with ``mix_``.
    """
    text, ident = F.col("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))
    body = F.coalesce(F.md5("text"), F.lit("~"))
    rows = docs.select(*(keep if keep is not None else docs.columns), F.col("source").alias("mix_source"),
                       n_words(text).alias("mix_size"),
                       F.md5(F.concat_ws(":", F.lit(str(mix.seed)), ident, body)).alias("mix_key"))
    narrow = rows.select("mix_source", "mix_size", "mix_key")
    n = narrow.count()
    digits = 1
    while 16 ** digits * mix.bucket_rows < n:
        digits += 1
    bucket = F.substring("mix_key", 1, digits)
    sums = stored(narrow.groupBy(F.col("mix_source").alias("source"), bucket.alias("bucket"))
                  .agg(F.sum("mix_size").alias("n")))
    before = F.sum("n").over(W.partitionBy("source").orderBy("bucket")
                             .rowsBetween(W.unboundedPreceding, -1))
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), mix)
    starts = (sums.withColumn("start", F.coalesce(before, F.lit(0)))
              .join(targets.withColumnRenamed("source", "target_source"),
                    F.col("source").eqNullSafe(F.col("target_source")))
              .select(F.col("source").alias("mix_source"), F.col("bucket").alias("mix_bucket"),
                      F.struct("start", "source_size", "kind", "target").alias("mix_s")))
    placed = join_summary(rows.withColumn("mix_bucket", bucket), starts,
                          ["mix_source", "mix_bucket"], "inner", salts=1)
    inside = F.sum("mix_size").over(W.partitionBy("mix_source", "mix_bucket").orderBy("mix_key")
                                    .rowsBetween(W.unboundedPreceding, -1))
    s = F.col("mix_s")
    placed = placed.withColumn("mix_at", s["start"] + F.coalesce(inside, F.lit(0)))
    room = s["target"] - F.col("mix_at") - F.col("mix_size") / 2
    copies = F.floor(F.try_divide(room, s["source_size"])) + 1
    copies = F.when(F.col("mix_size") == 0, F.lit(1)).otherwise(
        F.least(F.greatest(F.coalesce(copies, F.lit(0)), F.lit(0)), F.lit(mix.max_repeats)))
    spots = F.transform(F.sequence(F.lit(0), F.lit(mix.max_repeats - 1)),
                        lambda i: F.least(F.coalesce(F.try_divide(
                            F.col("mix_at") + i * s["source_size"], s["target"]), F.lit(0.0)), F.lit(1.0)))
    placed = placed.withColumn("mix_copies", copies.cast("int")) \
                   .withColumn("mix_spots", F.slice(spots, F.lit(1), F.col("mix_copies")))
    position = F.lit(None).cast("array<double>")
    for kind, schedule in enumerate(mix.schedules):
        position = F.when(s["kind"] == kind, _positions(F.col("mix_spots"), schedule)).otherwise(position)
    return placed.select(*(keep if keep is not None else docs.columns), "mix_key", "mix_size",
                         s["source_size"].alias("mix_source_size"), s["target"].alias("mix_target"),
                         "mix_copies", position.alias("mix_positions"))


def training_order(placed: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by training position: adds mix_position and mix_epoch."""
    each = placed.select("*", F.posexplode("mix_positions").alias("mix_epoch", "mix_position"))
    return (each.repartitionByRange("mix_position", "mix_key", "mix_epoch")
            .sortWithinPartitions("mix_position", "mix_key", "mix_epoch"))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """The mixed documents in training order with the columns of ``docs``: a document that
    the mix takes twice comes twice, one that it does not take is left out."""
    return training_order(assign_positions(docs, mix)).select(*docs.columns)
