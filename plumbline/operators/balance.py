"""Class balancing with exact quotas in seeded order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import first_of, order_key


def quotas(counts: dict[str, int], genuine: str, forged: Sequence[str]) -> tuple[int, int]:
    """(rows of each forged type, rows of each side) for a 1:1 balanced set."""
    each = min(counts.get(t, 0) for t in forged)
    return each, min(counts.get(genuine, 0), each * len(forged))


def balance(df: DataFrame, kind: str, ids: Sequence[str], genuine: str,
            forged: Sequence[str], seed: int = 42) -> DataFrame:
    """Equally many genuine and forged rows, the forged ones evenly from every type; the
    numbers are exact also where ids repeat.

    Each forged type gives as many rows as the rarest type has; the genuine side and
    the mixed forged side are then cut to the shorter of the two.  Only the row
    counts of the named types reach the driver.
    """
    kinds = [genuine, *forged]
    pool = df.filter(F.col(kind).isin(*kinds))
    row = pool.agg(*[F.count_if(F.col(kind) == k).alias(f"n{i}")
                     for i, k in enumerate(kinds)]).first()
    counts = {k: row[f"n{i}"] for i, k in enumerate(kinds)}
    each, side = quotas(counts, genuine, forged)
    wanted = {genuine: side, **{t: each for t in forged}}

    def size_of(_: Column) -> list[Column]:
        size = F.lit(0)
        for name, n in wanted.items():
            size = F.when(F.col(kind) == name, F.lit(n)).otherwise(size)
        return [size]

    chosen = first_of(pool, [kind], size_of, order_key(ids, seed))
    if side < each * len(forged):
        # Genuine rows are the shorter side: cut the mixed forged rows in a fresh order.
        mixed = first_of(chosen.filter(F.col(kind) != genuine), [], lambda _: [F.lit(side)],
                       order_key(ids, seed + 1))
        chosen = chosen.filter(F.col(kind) == genuine).unionByName(mixed)
    return chosen
