"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def components(links: DataFrame, jumps: int = 2) -> DataFrame:
    """The component of every linked vertex: (id, component), component being its least id.

    ``links`` has two columns a and b of one type, in any direction, repeats allowed.  In
    each round every vertex points to its least neighbour, pointers are followed ``jumps``
    times, and links are drawn anew between what is pointed at.  Links inside one vertex
    vanish, so the table shrinks until it is empty; chains shorten by a constant factor a
    round.  Every round is written to the shared folder.  At the end the rounds' pointers
    are put together backwards.  Vertices without a link to another are not returned.
    """
    edges = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"),
                                                 F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stored(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("to")))
        for _ in range(jumps):
            far = point.select(F.col("id").alias("to"), F.col("to").alias("far"))
            point = stored(point.join(far, "to").select("id", F.col("far").alias("to")))
        rounds.append(point)
        for end in ("a", "b"):
            moved = point.select(F.col("id").alias(end), F.col("to").alias("_to"))
            edges = edges.join(moved, end).drop(end).withColumnRenamed("_to", end)
        edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"),
                                                     F.greatest("a", "b").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = rounds.pop()
    while rounds:
        point = rounds.pop()
        far = out.select(F.col("id").alias("to"), "component" if "component" in out.columns
                         else F.col("to").alias("component"))
        out = stored(point.join(far, "to", "left").select(
            "id", F.coalesce("component", "to").alias("component")))
    return out if "component" in out.columns else out.withColumnRenamed("to", "component")
