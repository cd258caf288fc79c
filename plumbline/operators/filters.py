"""Row filters, routing and intake admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import as_col, count_or_zero

# Manifest vocabulary, routing names, intake limits.
GENUINE_ROW = "genuine"
KEPT, DISREGARDED = "kept", "disregarded"
MIN_COUNT = 4
EXTENSIONS = (".mp4", ".mov", ".webm", ".avi", ".mkv", ".flv")
MAX_MB = 500.0


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The frame itself, or ``ValueError`` naming the columns it lacks."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def has_columns(df: DataFrame, cols: Sequence[str]) -> bool:
    return set(cols) <= set(df.columns)


def keep_genuine(df: DataFrame, col: str) -> DataFrame:
    """Rows marked genuine.  A frame without the column is genuine throughout; an
    empty cell is not genuine."""
    return df.filter(F.col(col) == GENUINE_ROW) if col in df.columns else df


def keep_forged(df: DataFrame, col: str) -> DataFrame:
    """Rows not marked genuine.  Empty cells stay, as does a frame without the column."""
    return df.filter(~F.col(col).eqNullSafe(GENUINE_ROW)) if col in df.columns else df


def route_min_count(df: DataFrame, col: str, k: int = MIN_COUNT, out: str = "route") -> DataFrame:
    """Tag rows as kept when the count held as text in ``col`` is at least ``k``."""
    return df.withColumn(
        out, F.when(count_or_zero(col) >= k, KEPT).otherwise(DISREGARDED))


def route_summary(df: DataFrame, by: Sequence[str] = ("route",)) -> DataFrame:
    """Rows per route (and per split, with a ``'?'`` for rows that name none)."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in by]
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def extension(path: Column | str) -> Column:
    """Lower-cased suffix of the file name with its dot; '' when there is none."""
    name = F.regexp_extract(as_col(path), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def admit(df: DataFrame, path: str, length: str, exts: Sequence[str] = EXTENSIONS,
          max_mb: float = MAX_MB, out: str = "reject_reason") -> DataFrame:
    """Reason why a file is refused at intake, NULL when it is admitted.

    Works on batch and streaming frames alike.
    """
    reason = (F.when(~extension(path).isin(*exts), F.lit("unsupported format"))
              .when(F.col(length) / F.lit(1e6) > F.lit(float(max_mb)), F.lit("file too large")))
    return df.withColumn(out, reason)


def sufficient_detection(df: DataFrame, key: str, failed: Column | str,
                         max_ratio: float = 0.1) -> DataFrame:
    """Failure ratio per key and whether it stays within ``max_ratio``."""
    bad = F.sum(as_col(failed).cast("bigint"))
    return (df.groupBy(key).agg(F.count("*").alias("n"), bad.alias("n_failed"))
            .withColumn("ok", F.col("n_failed") <= F.col("n") * F.lit(max_ratio)))
