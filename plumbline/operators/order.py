"""Seeded order, exact cut points in that order, exact ranks, caps.

A seeded shuffle followed by a slice needs no global sort: the rows are ordered
by an md5 of (id, seed), which is uniform, so a small histogram over the first
hex digits tells in which bucket a slice boundary falls and only that bucket has
to be sorted.  What comes out is one row of boundary keys per stratum, and every
row is then placed by comparing its own key with the boundaries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import as_col
from ..session import is_small, join_summary, settle, stored

#: Hex digits of the md5 that form the histogram bucket (16**4 = 65 536 buckets).
DIGITS = 4

#: Rows of one group that a single window task may rank.
GROUP_ROWS = 5_000_000


def joined(cols: Sequence[Column | str]) -> Column:
    """The values as one string that tells different values apart: among several, a colon
    inside a value is doubled behind a mark, and NULL is a value of its own."""
    parts = [as_col(c).cast("string") for c in cols]
    if len(parts) > 1:
        parts = [F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit(":"), F.lit("~1")) for p in parts]
    return F.concat_ws(":", *[F.coalesce(p, F.lit("~")) for p in parts])


def seeded_order(cols: Sequence[Column | str], seed: int) -> Column:
    """The md5 of the values and the seed; sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws(":", joined(cols), F.lit(str(seed))))


def order_key(cols: Sequence[Column | str], seed: int) -> Column:
    """Seeded order with the id itself as tie-break, as one sortable string."""
    return F.concat_ws(":", seeded_order(cols, seed), joined(cols))


@dataclass(frozen=True)
class Cuts:
    """Boundary keys, one row per stratum, and whether that table may be broadcast."""

    frame: DataFrame
    strata: tuple[str, ...]
    count: int
    small: bool

    def settled(self) -> Cuts:
        """The same cuts computed once, for rows that are read more than once."""
        return replace(self, frame=settle(self.frame))


def cut_points(units: DataFrame, strata: Sequence[str], key: str, weight: str | None,
               targets: Callable[[Column], Sequence[Column]], few_strata: bool = False,
               digits: int = DIGITS) -> Cuts:
    """Boundary keys of cumulative-count cuts, one row per stratum.

    ``units`` holds one row per unit with its strata, its :func:`order_key` in
    ``key`` and an optional ``weight`` (1 each by default).  ``targets`` maps the
    stratum's total weight to cumulative limits, and may refer to the strata columns.
    ``cut_i`` is the largest key for
    which the weight *before* it is below limit ``i``; NULL when no unit qualifies.

    Two narrow passes over ``units``: a histogram with map-side combine, then the
    boundary buckets alone.  Each histogram window sees at most ``16**digits``
    rows per stratum.  The boundary table has one row per stratum and cut.  It is
    settled and counted to decide how it may be joined, unless there are no strata or
    the caller has bounded them by naming them (``few_strata``).
    """
    strata = list(strata)
    count = len(targets(F.lit(0)))
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    base = units.select(*strata, F.col(key).alias("_key"), w.alias("_w"),
                        F.substring(F.col(key), 1, digits).alias("_b"))
    # Without strata the window key is a constant: at most 16**digits rows reach it.
    over = [F.col(s) for s in strata] or [F.lit(0)]
    hist = base.groupBy(*strata, "_b").agg(F.sum("_w").alias("_bw"))
    before = F.sum("_bw").over(
        W.partitionBy(*over).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    n = F.sum("_bw").over(W.partitionBy(*over))
    limits = hist.select(*strata, "_b", "_bw", F.coalesce(before, F.lit(0)).alias("_lo"),
                         n.alias("_n"))
    limits = limits.select(
        *strata, "_b", "_bw", "_lo",
        F.posexplode(F.array(*[F.least(t.cast("bigint"), F.col("_n"))
                               for t in targets(F.col("_n"))])).alias("_cut", "_t"))
    edge = limits.filter((F.col("_lo") < F.col("_t")) & (F.col("_t") <= F.col("_lo") + F.col("_bw")))
    edge = edge.drop("_bw")
    small = True
    if strata and not few_strata:
        edge = settle(edge)
        small = is_small(edge)
    # The bucket is a hash prefix: no key of this join is hot, whatever the strata are.
    near = join_summary(base, edge, [*strata, "_b"], "inner", small, salts=1)
    inside = F.sum("_w").over(
        W.partitionBy(*strata, "_cut").orderBy("_key").rowsBetween(W.unboundedPreceding, -1))
    near = near.withColumn("_before", F.col("_lo") + F.coalesce(inside, F.lit(0)))
    near = near.filter(F.col("_before") < F.col("_t"))
    cuts = near.groupBy(*strata).agg(*[
        F.max(F.when(F.col("_cut") == i, F.col("_key"))).alias(f"cut_{i}") for i in range(count)])
    return Cuts(cuts, tuple(strata), count, small)


def place(rows: DataFrame, cuts: Cuts, key: Column, names: Sequence[object],
          out: str) -> DataFrame:
    """Name the slice every row falls into: one name per cut and one for the rest."""
    if len(names) != cuts.count + 1:
        raise ValueError("need one more name than cuts")
    if cuts.strata:
        joined = join_summary(rows.withColumn("_key", key), cuts.frame, cuts.strata, "left",
                              cuts.small)
        own, limits = F.col("_key"), [F.col(f"cut_{i}") for i in range(cuts.count)]
    else:
        # A global aggregate has exactly one row: read it as a scalar, without a join.
        bounds = cuts.frame.select(F.struct(*cuts.frame.columns)).scalar()
        joined, own, limits = rows, key, [bounds[f"cut_{i}"] for i in range(cuts.count)]
    slot = F.lit(names[-1])
    for name, limit in reversed(list(zip(names, limits, strict=False))):
        slot = F.when(own <= limit, F.lit(name)).otherwise(slot)
    return joined.withColumn(out, slot).select(*rows.columns, out)


def ranked(df: DataFrame, part: Sequence[str], order: Sequence[Column | str], out: str = "rank",
           size: str | None = None, group_rows: int = GROUP_ROWS, most: int | None = None) -> DataFrame:
    """Exact 1-based rank within ``part`` by any sort columns, safe for huge groups.

    The largest group is measured first, unless the caller knows a bound, ``most``.  Where it fits one task this is a plain
    ``row_number``.  Otherwise the rows are range-partitioned by (part, order), so
    one group spreads over many partitions, ranked inside each, and shifted by the
    number of rows of the same group in earlier partitions.  ``size`` names a further
    column for the row count of the group.
    """
    part = list(part)
    keys = [as_col(c) for c in order]
    whole = W.partitionBy(*(part or [F.lit(0)]))
    top, n = most, None
    if most is None or most > group_rows:
        top, n = df.groupBy(*part).count().agg(F.max("count"), F.sum("count")).first()
    if top is None or top <= group_rows:
        ranks = df.withColumn(out, F.row_number().over(whole.orderBy(*keys)).cast("bigint"))
        return ranks.withColumn(size, F.count("*").over(whole)) if size else ranks
    ways = max(2, 2 * -(-n // group_rows))
    split = stored(df.repartitionByRange(ways, *part, *keys)
                   .withColumn("_pid", F.spark_partition_id()))
    # One row per group and partition: at most (groups + ways) rows.
    shift = F.sum("_n").over(whole.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1))
    offsets = (split.groupBy(*part, "_pid").agg(F.count("*").alias("_n"))
               .select(*part, "_pid", F.coalesce(shift, F.lit(0)).alias("_shift"),
                       F.sum("_n").over(whole).alias("_size")))
    local = F.row_number().over(W.partitionBy(*part, "_pid").orderBy(*keys))
    ranks = (join_summary(split.withColumn("_local", local), offsets, [*part, "_pid"], salts=1)
             .withColumn(out, F.col("_local") + F.col("_shift")))
    ranks = ranks.withColumn(size, F.col("_size")) if size else ranks
    return ranks.drop("_local", "_shift", "_pid", "_size")


def cap(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """First ``n`` rows of an order, for an ``n`` that fits one task."""
    return df.orderBy(*[as_col(c) for c in order]).limit(n)


def cap_seeded(df: DataFrame, n: int, ids: Sequence[Column | str], seed: int) -> DataFrame:
    """First ``n`` rows of the seeded order without sorting, for an ``n`` of any size."""
    return first_of(df, [], lambda _: [F.lit(n)], order_key(ids, seed))


def first_of(df: DataFrame, strata: Sequence[str], sizes: Callable[[Column], Sequence[Column]],
             key: Column) -> DataFrame:
    """The given number of rows of each stratum in key order, exact also where keys repeat.

    One pass counts rows per stratum and bucket of the key, which tells the bucket where a
    stratum's share ends and how many rows of that bucket are still wanted.  For strata
    that the caller has bounded by naming them this is one small table.  Rows in earlier buckets are
    in; only those in the last one are ranked, and Spark cuts them before the shuffle.
    """
    strata = list(strata)
    over = W.partitionBy(*([F.col(s) for s in strata] or [F.lit(0)]))
    hist = df.select(*strata, F.substring(key, 1, DIGITS).alias("_b")).groupBy(*strata, "_b").agg(
        F.count(F.lit(1)).alias("_bw"))
    before = F.sum("_bw").over(over.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    limits = hist.select(*strata, "_b", "_bw", F.coalesce(before, F.lit(0)).alias("_lo"), F.sum("_bw").over(over).alias("_n"))
    target = F.least(sizes(F.col("_n"))[0].cast("bigint"), F.col("_n"))
    edge = settle(limits.withColumn("_t", target).filter(
        (F.col("_lo") < F.col("_t")) & (F.col("_t") <= F.col("_lo") + F.col("_bw"))).select(
            *strata, F.struct(F.col("_b").alias("b"), (F.col("_t") - F.col("_lo")).alias("room")).alias("_edge")))
    if strata:
        marked = join_summary(df, edge, strata, "inner", small=True)
    else:
        marked = df.withColumn("_edge", edge.select("_edge").scalar())
    marked = marked.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, DIGITS))
    rank = F.row_number().over(over.orderBy("_k"))
    last = marked.filter(F.col("_b") == F.col("_edge.b")).withColumn("_rn", rank).filter(F.col("_rn") <= F.col("_edge.room"))
    return marked.filter(F.col("_b") < F.col("_edge.b")).unionByName(last.drop("_rn")).select(*df.columns)


def top_per_group(df: DataFrame, part: Sequence[str], order: Sequence[Column | str],
                  k: int) -> DataFrame:
    """First ``k`` rows of every group; Spark cuts each group before the shuffle."""
    over = W.partitionBy(*part).orderBy(*[as_col(c) for c in order])
    return (df.withColumn("_rn", F.row_number().over(over))
            .filter(F.col("_rn") <= k).drop("_rn"))
