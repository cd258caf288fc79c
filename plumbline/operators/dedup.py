"""Keep-first deduplication in two orders of composition.

``row_number() = 1`` is cut per key before the shuffle, so a key with very many
copies sends one row per input partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from .order import top_per_group


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of every key in the given order."""
    return top_per_group(df, keys, order, 1)


def dedup_then_filter(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                      keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A first copy that fails the filter hides the later copies."""
    return keep(dedup_first(df, keys, order))


def filter_then_dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                      keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first copy that passes the filter is kept."""
    return dedup_first(keep(df), keys, order)
