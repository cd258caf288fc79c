"""Hard-negative mining by bounds along a spanning tree of anchors.

The score of a row for an anchor is the inner product of their quantised vectors.  Anchors
that lie near each other score a row alike: if ``e`` is the distance of an anchor to its
parent in a spanning tree, the anchor's score differs from the parent's by ``e`` times the
row's norm at most.  Walking the tree from its root, whose scores are computed in full, every
anchor gets an interval for the score of every row, from its parent's score or interval.
Only rows whose interval meets what the anchor still looks for are scored: its window, and
scores that are not below the last of its list so far.  The lists are exact.

Anchors are taken in chunks of bounded size that are broadcast; all rows are read once or
twice a chunk and never shuffled.  What is shuffled is a short list per anchor and task.
Work is anchors times rows in numpy blocks; memory in a task is one block and the lists of one chunk.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import top_per_group
from ..session import stored
from .common import shared

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Scaled components beyond this do not take part, so that all scores fit a long.
MOST = 2 ** 24


@dataclass(frozen=True)
class Mining:
    """Parameters.  A negative fits a positive if low * p <= 100 * n <= high * p.

    ``chunk`` anchors are broadcast at a time, ``tree`` of them share one spanning tree, and
    ``block`` rows are scored at a time."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    chunk: int = 8192
    tree: int = 1024
    block: int = 4096


@dataclass(frozen=True)
class Forest:
    """Anchors in an order in which parents come first.  ``parent`` is -1 for a root,
    ``edge`` the distance to the parent, ``last`` the last child of each anchor."""

    row: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    last: np.ndarray


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The minimum spanning tree by distance, grown from the first vector: the order in
    which vectors join and their parents (places in that order)."""
    n = len(vectors)
    norms = (vectors * vectors).sum(axis=1)
    order, parent = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    best, by, inside = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    new = 0
    for at in range(n):
        order[at], inside[new] = new, True
        if at:
            parent[at] = by[new]
        apart = np.maximum(norms + norms[new] - 2 * (vectors @ vectors[new]), 0)
        closer = apart < best
        best[closer], by[closer] = apart[closer], at
        new = int(np.where(inside, np.inf, best).argmin())
    return order, parent


def plant(row: np.ndarray, label: np.ndarray, vector: np.ndarray, size: int) -> Forest:
    """Spanning trees over ``size`` anchors each.  Anchors of one label stand together, as
    they are likely to be near each other."""
    by = np.lexsort((row, label))
    row, label, vector = row[by], label[by], vector[by]
    orders, parents = [], []
    for start in range(0, len(row), size):
        order, parent = spanning_tree(vector[start:start + size])
        orders.append(order + start)
        parents.append(np.where(parent < 0, -1, parent + start))
    order = np.concatenate([np.zeros(0, np.int64), *orders])
    parent = np.concatenate([np.zeros(0, np.int64), *parents])
    last = np.full(len(order), -1, np.int64)
    for child, p in enumerate(parent):
        if p >= 0:
            last[p] = child
    vector = vector[order]
    edge = np.sqrt(((vector - vector[np.maximum(parent, 0)]) ** 2).sum(axis=1))
    return Forest(row[order], label[order], vector, parent, edge, last)


class Lists:
    """The best ``k`` rows of each slot so far: score first, ties by id, then by row."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [
            (np.zeros(0, np.int64),) * 3 for _ in range(slots)]
        self.floor = np.full(slots, -np.inf)

    def add(self, slot: int, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        fits = score >= self.floor[slot]
        if not fits.any():
            return
        score, ident, row = (np.concatenate([old, new[fits]]) for old, new in
                             zip(self.held[slot], (score, ident, row), strict=True))
        best = np.lexsort((row, ident, -score))[:self.k]
        self.held[slot] = (score[best], ident[best], row[best])
        if len(best) == self.k:
            self.floor[slot] = score[best[-1]]


def walk(forest: Forest, vectors: np.ndarray, norms: np.ndarray, wanted, found) -> int:
    """Bounds down the trees for one block of rows; returns how many scores were computed.

    ``wanted(a)`` gives the least and the largest score that anchor ``a`` looks for and which
    rows may be meant; ``found(a, places, scores)`` gets the rows that were scored.
    """
    alive: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scored = 0
    for a in range(len(forest.row)):
        least, most, may = wanted(a)
        p = int(forest.parent[a])
        if p < 0:
            low = high = vectors @ forest.vector[a]
            scored += len(vectors)
            at = np.flatnonzero(may & (low >= least) & (low <= most))
            found(a, at, low[at])
        else:
            # A little is added for the rounding of distances, norms and very large scores.
            slack = forest.edge[a] * norms * (1 + 1e-9) + (1e-6 if vectors.dtype == np.float64 else 4096)
            low, high = alive[p][0] - slack, alive[p][1] + slack
            at = np.flatnonzero(may & (high >= least) & (low <= most))
            scores = vectors[at] @ forest.vector[a]
            scored += len(at)
            low[at] = high[at] = scores
            found(a, at, scores)
            if forest.last[p] == a:
                del alive[p]
        if forest.last[a] >= 0:
            alive[a] = (low, high)
    return scored


def _blocks(batches: Iterator[pa.RecordBatch], width: int, size: int
            ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, id, label and vectors (missing components are 0) of up to ``size`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            vectors = part.column("llm_vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            out = np.zeros((part.num_rows, width))
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out[np.repeat(np.arange(part.num_rows), lengths), place] = vectors.flatten().to_numpy()
            row, ident, label = (part.column(c).to_numpy() for c in ("llm_row", "llm_id", "llm_label"))
            yield row, ident, label, out


def _inner(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """The vectors in a type in which inner products with all anchors are exact."""
    # By Cauchy and Schwarz no partial sum is above the product of the norms.
    most = np.sqrt(max((forest.vector ** 2).sum(axis=1).max(initial=0), 1)
                   * max((vectors ** 2).sum(axis=1).max(initial=0), 1))
    return vectors if most < 2 ** 52 else vectors.astype(np.int64)


def _searched(rows: DataFrame, get, slots: int, k: int, width: int, block: int, label_equal: bool) -> DataFrame:
    """Per anchor slot of the chunk the best ``k`` rows in its window, from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, low, high = get()
        lists = Lists(slots * len(forest.row), k)
        least, most = low.min(axis=1, initial=np.inf), high.max(axis=1, initial=-np.inf)
        for row, ident, label, vectors in _blocks(batches, width, block):
            exact = _inner(forest, vectors)
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            tree = forest if exact.dtype == np.float64 else Forest(
                forest.row, forest.label, forest.vector.astype(np.int64), forest.parent, forest.edge, forest.last)
            same: dict[int, np.ndarray] = {}

            def wanted(a: int):
                mark = int(forest.label[a])
                if mark not in same:
                    same[mark] = label == mark if label_equal else label != mark
                floors = lists.floor[a * slots:(a + 1) * slots]
                return max(least[a], np.maximum(low[a], floors).min(initial=np.inf)), most[a], same[mark]

            def found(a: int, at: np.ndarray, scores: np.ndarray) -> None:
                other = row[at] != forest.row[a]
                at, scores = at[other], scores[other].astype(np.int64)
                for s in range(slots):
                    fits = (scores >= max(low[a, s], lists.floor[a * slots + s])) & (scores <= high[a, s])
                    if fits.any():
                        lists.add(a * slots + s, scores[fits], ident[at[fits]], row[at[fits]])

            walk(tree, exact, norms, wanted, found)
        counts = [len(h[0]) for h in lists.held]
        slot = np.repeat(np.arange(len(counts)), counts)
        score, ident, row = (np.concatenate([np.zeros(0, np.int64), *[h[i] for h in lists.held]]) for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(forest.row[slot // max(slots, 1)]), pa.array((slot % max(slots, 1)).astype(np.int32)),
             pa.array(score), pa.array(ident), pa.array(row)], ["anchor", "slot", "score", "ident", "row"])

    each = rows.mapInArrow(run, "anchor long, slot int, score long, ident long, row long")
    return top_per_group(each, ["anchor", "slot"], [F.col("score").desc(), "ident", "row"], k)


def prepare(rows: DataFrame, scale: int) -> DataFrame:
    """The rows that take part: llm_row, llm_id, llm_label, llm_vector (floor of scale * x).

    Left out are rows without id, label or vector, and those with a null, non-finite or
    huge component.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) * scale < MOST))  # false for NaN, too
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    part = rows.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return part.select(F.monotonically_increasing_id().alias("llm_row"), F.col("vec_id").cast("long").alias("llm_id"),
                       F.col("label").cast("long").alias("llm_label"), F.when(fine, whole).alias("llm_vector"))


def _windows(forest: Forest, chosen: dict[int, list[int]], mining: Mining) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor and positive the least and the largest score of its negatives."""
    low = np.full((len(forest.row), mining.positives), np.inf)
    high = np.full((len(forest.row), mining.positives), -np.inf)
    for a, row in enumerate(forest.row.tolist()):
        for s, score in enumerate(chosen.get(row, ())):
            low[a, s], high[a, s] = -(-mining.low * score // 100), mining.high * score // 100
    return low, high


def mine_negatives(rows: DataFrame, anchors: Callable[[Column], Column], mining: Mining = Mining()) -> DataFrame:  # noqa: B008
    """Hard negatives for each anchor and positive.

    ``rows`` has vec_id, label and embedding, other columns are not looked at.  ``anchors``
    tells from a vec_id whether its row is one.  An anchor's positives are its best other rows of its label,
    its negatives for one of them the best rows of other labels in the window of that
    positive's score.  Best is by score, then by the lesser vec_id.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    Anchors without a positive, and positives without a row in their window, have no rows.
    Rows without id, label or vector, or with a null, non-finite or huge component take no
    part.  In vectors of unequal length, missing components count as 0.  Repeated rows are
    rows of their own: each is another row to its copies, and if they are anchors each gives
    its rows.  An empty table gives none.
    """
    spark = rows.sparkSession
    ready = stored(prepare(rows, mining.scale))
    picked = ready.filter(F.coalesce(anchors(F.col("llm_id")), F.lit(False)))
    count, width = picked.count(), ready.agg(F.max(F.size("llm_vector"))).first()[0] or 0
    chunks = max(1, -(-count // mining.chunk))
    out = None
    for part in range(chunks):
        # Dealt by a hash: about ``chunk`` anchors, whatever their number is in all.
        batch = picked.filter(F.pmod(F.xxhash64("llm_row"), F.lit(chunks)) == part).toArrow()
        found = [np.zeros((0, width)), *[b[3] for b in _blocks(iter(batch.to_batches()), width, mining.chunk)]]
        row, label, ident = (batch.column(c).to_numpy().copy() for c in ("llm_row", "llm_label", "llm_id"))
        forest = plant(row, label, np.concatenate(found), mining.tree)
        any_score = (np.full((len(row), 1), -np.inf), np.full((len(row), 1), np.inf))
        names = dict(zip(row.tolist(), ident.tolist(), strict=True))
        positives = stored(_searched(ready, shared(spark, (forest, *any_score)), 1, mining.positives, width,
                                     mining.block, True))
        chosen: dict[int, list[tuple[int, int, int]]] = {}
        for r in positives.collect():  # mining.positives rows for each anchor of the chunk
            chosen.setdefault(r.anchor, []).append((-r.score, r.ident, r.row))
        for held in chosen.values():
            held.sort()
        windows = _windows(forest, {a: [-s for s, _, _ in held] for a, held in chosen.items()}, mining)
        negatives = _searched(ready, shared(spark, (forest, *windows)), mining.positives, mining.negatives, width,
                              mining.block, False)
        of = [(a, s, names[a], ident, -score) for a, held in chosen.items() for s, (score, ident, _) in enumerate(held)]
        pairs = spark.createDataFrame(
            pa.table([pa.array(c, t) for c, t in zip(
                zip(*of, strict=True) if of else [[]] * 5,
                (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["anchor", "slot", "anchor_id", "positive_id", "positive_score"]))
        ranked = stored(_with_rank(negatives).join(F.broadcast(pairs), ["anchor", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("ident").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")))
        out = ranked if out is None else out.unionAll(ranked)
    return out


def _with_rank(lists: DataFrame) -> DataFrame:
    over = W.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "ident", "row")
    return lists.withColumn("rank", F.row_number().over(over))
