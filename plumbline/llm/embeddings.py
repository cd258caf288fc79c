"""Embedding near-duplicates by NN-descent.

Equal vectors are one class.  A neighbour graph over the classes starts from several
sorts by random hyperplane codes, each cut into small blocks.  It is then refined: all
members of a node's neighbourhood, to and from, meet in one task and are compared with each
other, and every node keeps its best ``k``.  Rounds end when hardly any link at or above
the threshold is added.

A node whose whole list lies above the threshold is saturated: it may have more links than
the list holds.  Links that blocks or joins have found and lists cannot hold are kept beside
the graph, as many as tie together what they tie together, and components follow from both.
A saturated node is then compared with all nodes of its component, tile by tile, so that no
link found is ever lost and no group is ever in one task.  Nodes drawn
by hash are compared with all vectors to audit the recall, until enough of them have links;
further sorts are added while it is too low, and it is an error if they do not help.

All cosines are computed in double precision from the given components.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import join_summary, stored
from .components import components

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Descent:
    """Parameters: list length, sorts per round, block and tile sizes, and the audit.

    ``audit_nodes`` is the number of nodes with links the audit asks for; it draws at most
    ``audit_most`` of all nodes, and as many of those that came within ``margin`` of a link.
    ``rounds`` is how many rounds in a row may leave the recall as low as it was.
    """

    threshold: float = 0.95
    k: int = 8
    sorts: int = 8
    bits: int = 24
    block: int = 64
    iterations: int = 4
    settled: float = 0.002
    tile: int = 1024
    audit_nodes: int = 200
    audit_most: int = 8192
    margin: float = 0.02
    recall: float = 0.98
    rounds: int = 4
    seed: int = 11


def unit_rows(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length as a matrix padded with zeros, and their lengths."""
    rows = [np.frombuffer(b, np.float64) for b in blobs]
    sizes = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), int(sizes.max(initial=0))))
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    # The largest component first, so that squares neither overflow nor vanish.
    out /= np.abs(out).max(axis=1, keepdims=True, initial=0) + (len(rows) == 0)
    out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out, sizes


def cosines(left: list[bytes], right: list[bytes] | None = None) -> np.ndarray:
    """All cosines between two lists of vectors; -2 where the lengths differ."""
    a, m = unit_rows(left)
    b, n = (a, m) if right is None else unit_rows(right)
    width = min(a.shape[1], b.shape[1])
    return np.where(m[:, None] == n, a[:, :width] @ b[:, :width].T, -2.0)


def _components() -> tuple[Column, Column]:
    """The components of a vector in doubles, without negative zeros, and whether it is usable."""
    doubles = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(doubles, lambda x: x != 0)
    return doubles, F.coalesce(~bad & some, F.lit(False))


def classes(vectors: DataFrame) -> DataFrame:
    """One row per different usable vector: node (its hash), vec (its doubles as bytes), n
    (rows that have it), first_id (their least vec_id)."""
    doubles, usable = _components()
    distinct = (vectors.select("vec_id", doubles.alias("d"), usable.alias("u")).filter("u")
                .groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.array(x, np.float64).tobytes() for x in batch.column("d").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(blobs, pa.binary()), batch.column("n"), batch.column("first_id")],
                ["node", "vec", "n", "first_id"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return distinct.select(F.xxhash64("d").alias("node"), "d", "n", "first_id").mapInArrow(
        pack, f"node long, vec binary, n long, first_id {kind}")


def _ranked(edges: DataFrame) -> DataFrame:
    """The given (a, b, s), each once, with the rank r of b among the neighbours of a."""
    one = edges.groupBy("a", "b").agg(F.max("s").alias("s"))
    return one.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("s"), "b")))


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Every node's ``k`` nearest of the given (a, b, s), each once."""
    return _ranked(edges).filter(F.col("r") <= k).drop("r")


def _lists_and_cut(edges: DataFrame, spec: Descent) -> tuple[DataFrame, DataFrame]:
    """Every node's ``spec.k`` nearest, and the links that hold but have no place in a list."""
    kept = stored(_ranked(edges).filter((F.col("r") <= spec.k) | (F.col("s") >= spec.threshold)))
    return kept.filter(F.col("r") <= spec.k).drop("r"), kept.filter(F.col("r") > spec.k).select("a", "b")


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that tie together what the symmetric matrix ``hit`` ties together."""
    out, fresh = [], np.ones(len(hit), bool)
    for root in np.flatnonzero(hit.any(axis=1)).tolist():
        todo = [root] if fresh[root] else []
        fresh[root] = False
        while todo:
            at = todo.pop()
            more = np.flatnonzero(hit[at] & fresh)
            fresh[more] = False
            todo += more.tolist()
            out += [(at, b) for b in more.tolist()]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def sorted_blocks(nodes: DataFrame, spec: Descent, start: int) -> DataFrame:
    """Edges between vectors that lie close in one of ``spec.sorts`` sorts by hyperplane code."""
    seed, bits, sorts, block, k = spec.seed, spec.bits, spec.sorts, spec.block, spec.k
    threshold = spec.threshold

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            blobs = batch.column("vec").to_pylist()
            if not blobs:
                continue
            rows, sizes = unit_rows(blobs)
            for sort in range(start, start + sorts):
                keys = np.zeros(len(rows), np.int64)
                for size in np.unique(sizes).tolist():
                    if (sort, size) not in planes:
                        rng = np.random.default_rng([seed, sort, size])
                        planes[sort, size] = rng.standard_normal((size, bits))
                    own = sizes == size
                    signs = rows[own, :size] @ planes[sort, size] > 0
                    keys[own] = signs @ (1 << np.arange(bits - 1, -1, -1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sort] * len(rows), pa.int32()), pa.array(keys), batch.column("node"),
                     batch.column("vec")], ["sort", "code", "node", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs = batch.column("node").to_numpy(), batch.column("vec").to_pylist()
            sort = batch.column("sort").to_numpy()
            # Blocks overlap by half, so that neighbours are seldom parted.
            for at in range(0, max(1, len(ids) - block // 2), block // 2):
                own = ids[at:at + block]
                found = cosines(blobs[at:at + block])
                same = sort[at:at + block]
                found[same[:, None] != same] = -2.0
                np.fill_diagonal(found, -2.0)
                near = np.argsort(-found, axis=1)[:, :k]
                a, b = np.repeat(own, near.shape[1]), own[near].ravel()
                s = np.take_along_axis(found, near, axis=1).ravel()
                if near.shape[1] == k and (s.reshape(near.shape)[:, -1] >= threshold).any():
                    i, j = _forest(found >= threshold)
                    a, b, s = (np.append(a, own[i]), np.append(b, own[j]), np.append(s, found[i, j]))
                keep = s > -2.0
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, s)], ["a", "b", "s"])

    coded = nodes.select("node", "vec").mapInArrow(code, "sort int, code long, node long, vec binary")
    ordered = coded.repartitionByRange("sort", "code", "node").sortWithinPartitions("sort", "code", "node")
    return ordered.mapInArrow(compare, "a long, b long, s double")


def local_join(graph: DataFrame, nodes: DataFrame, fresh: DataFrame | None, spec: Descent) -> DataFrame:
    """Neighbours of neighbours: edges better than the last one in either node's list, and
    links enough to tie together what the members' cosines tie together.

    Centres are nodes and their members the nodes they point to or are pointed at from, the
    nearest ``k`` of the latter.  With ``fresh``, only centres whose lists have changed join.
    """
    k, threshold = spec.k, spec.threshold
    back = _best(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"), k)
    members = graph.select("a", "b").unionAll(back.select("a", "b")).distinct()
    if fresh is not None:
        members = members.join(fresh, "a", "left_semi")
    last = graph.groupBy("a").agg(F.when(F.count("s") >= k, F.min("s")).alias("last"))
    known = nodes.select("node", "vec").join(last, nodes["node"] == last["a"], "left").select(
        F.col("node").alias("b"), "vec", F.coalesce("last", F.lit(-2.0)).alias("last"))
    cells = members.join(known, "b")

    def join(cell: pd.DataFrame) -> pd.DataFrame:
        ids, last = cell["b"].to_numpy(), cell["last"].to_numpy()
        found = cosines(list(cell["vec"]))
        np.fill_diagonal(found, -2.0)
        better, hit = found > last[:, None], found >= threshold
        if (hit & ~better).any():
            better[_forest(hit)] = True
        i, j = np.nonzero(better)
        return pd.DataFrame({"a": ids[i], "b": ids[j], "s": found[i, j]})

    return cells.groupBy("a").applyInPandas(join, "a long, b long, s double")


def descend(graph: DataFrame, nodes: DataFrame, spec: Descent) -> tuple[DataFrame, DataFrame]:
    """Refine the graph until an iteration adds hardly any link: the lists, and the links
    (a, b) that were found but have no place in a list."""
    (graph, cut), fresh = _lists_and_cut(graph, spec), None
    links = graph.filter(F.col("s") >= spec.threshold).count()
    for _ in range(spec.iterations):
        found = local_join(graph, nodes, fresh, spec)
        after, more = _lists_and_cut(graph.unionAll(found), spec)
        cut = cut.unionAll(more)
        fresh = after.join(graph, ["a", "b"], "left_anti").select("a").distinct()
        graph, before = after, links
        links = graph.filter(F.col("s") >= spec.threshold).count()
        if links - before <= spec.settled * before:
            break
    return graph, cut


def enlarged(graph: DataFrame, cut: DataFrame, nodes: DataFrame, spec: Descent) -> tuple[DataFrame, DataFrame]:
    """Rows linked to every node (node, linked), and the components (id, component).

    ``cut`` holds the links beyond the lists.  They have saturated nodes at both ends or are
    in the other end's list, so that components they tie together are compared in tiles.

    Where a component holds a saturated node, all of its nodes are compared with each other
    in tiles, and only their counts leave a tile: rows grow with nodes times tiles.  Other
    nodes count the links of their lists.  A node's own further rows are not counted here.
    """
    near = graph.filter(F.col("s") >= spec.threshold)
    linked = stored(near.select("a", "b"))
    groups = stored(components(linked.unionAll(cut)))
    full = (near.groupBy("a").count().filter(F.col("count") >= spec.k)
            .join(groups, F.col("a") == F.col("id")).select("component").distinct())
    tiles = F.greatest(F.lit(1), F.ceil(F.col("size") / spec.tile)).cast("int")
    sizes = (groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).join(full, "component")
             .select("component", tiles.alias("tiles")))
    inside = stored(join_summary(groups, sizes, ["component"], "inner"))
    placed = (inside.join(nodes.select("node", "vec", "n"), F.col("id") == F.col("node"))
              .withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "component", "node", "vec", "n", "own", F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"))
    threshold = spec.threshold

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        own = (cell["own"] == cell["i"]).to_numpy()
        ids, blobs, rows = (cell[c].to_numpy() for c in ("node", "vec", "n"))
        if own.all():
            hit = cosines(list(blobs)) >= threshold
            np.fill_diagonal(hit, False)
            return pd.DataFrame({"node": ids, "linked": hit @ rows})
        if not own.any():
            return pd.DataFrame({"node": [], "linked": []}, dtype=np.int64)
        hit = cosines(list(blobs[own]), list(blobs[~own])) >= threshold
        return pd.DataFrame({"node": np.concatenate([ids[own], ids[~own]]),
                             "linked": np.concatenate([hit @ rows[~own], hit.T @ rows[own]])})

    counted = cells.groupBy("component", "i", "j").applyInPandas(compare, "node long, linked long")
    both = linked.unionAll(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    others = both.join(inside.select(F.col("id").alias("a")), "a", "left_anti").join(
        nodes.select(F.col("node").alias("b"), F.col("n").alias("linked")), "b").select(F.col("a").alias("node"), "linked")
    return counted.unionAll(others).groupBy("node").agg(F.sum("linked").alias("linked")), groups


def audit(linked: DataFrame, nodes: DataFrame, spec: Descent, suspects: DataFrame | None = None) -> float:
    """Mean share of the rows linked to a node that were found, over nodes that have any.

    Nodes are drawn by hash and compared with all vectors, until ``spec.audit_nodes`` of them
    have links, all are drawn, or ``spec.audit_most`` are.  Where links are so rare, nodes of
    ``suspects`` (column a: nodes that came near a link) are drawn in the same way, so that
    the work is that of a bounded number of nodes against all.  Each node with a link counts the same,
    however many rows it is linked to.  Only links that hold are counted in ``linked``.
    Without any link the recall is 1.
    """
    shares = _shares(linked, nodes, nodes, spec, [])
    if suspects is not None and len(shares) < spec.audit_nodes and nodes.count() > spec.audit_most:
        near = stored(nodes.join(suspects.select(F.col("a").alias("node")).distinct(), "node", "left_semi"))
        shares = _shares(linked, nodes, near, spec, shares)
    return sum(shares) / len(shares) if shares else 1.0


def _shares(linked: DataFrame, nodes: DataFrame, pool: DataFrame, spec: Descent, shares: list[float]) -> list[float]:
    """``shares`` and those of nodes drawn from ``pool``."""
    n, span, threshold = pool.count(), 1 << 30, spec.threshold
    place = F.pmod(F.xxhash64("node", F.lit(spec.seed)), F.lit(span))
    last = min(span, -(-span * spec.audit_most // max(n, 1)))
    low, width = 0, spec.audit_nodes
    while n and low < last and len(shares) < spec.audit_nodes:
        high = min(last, low + -(-span * width // n))
        drawn = stored(pool.filter((place >= low) & (place < high)).select("node", "vec"))
        low, width = high, min(2 * width, 4096)
        chosen = drawn.toArrow()
        ids, blobs = chosen.column("node").to_numpy(), chosen.column("vec").to_pylist()
        if not len(ids):
            continue
        shared = nodes.sparkSession.sparkContext.broadcast((ids, blobs))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted, vecs = shared.value
            for batch in batches:
                own, rows = batch.column("node").to_numpy(), batch.column("n").to_numpy()
                have = batch.column("vec").to_pylist()
                for at in range(0, len(wanted) if len(own) else 0, 512):
                    some = wanted[at:at + 512]
                    hit = cosines(have, vecs[at:at + 512]) >= threshold
                    hit &= own[:, None] != some
                    real = rows @ hit
                    yield pa.RecordBatch.from_arrays([pa.array(some[real > 0]), pa.array(real[real > 0])], ["node", "n"])

        real = (nodes.select("node", "vec", "n").mapInArrow(count, "node long, n long")
                .groupBy("node").agg(F.sum("n").alias("n")))
        seen = linked.join(F.broadcast(drawn.select("node")), "node")
        both = real.join(seen, "node", "left").select("n", F.coalesce("linked", F.lit(0)).alias("linked")).collect()
        shares = shares + [r["linked"] / r["n"] for r in both]
    return shares


def near_duplicate_vectors(vectors: DataFrame, spec: Descent = Descent()) -> DataFrame:  # noqa: B008
    """Links and component of every row of (vec_id, embedding): vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows linked directly; rows with equal vectors are linked.
    ``component_id`` is the least vec_id reachable, the own one included; ``kept`` says
    whether that is the own one.  Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, as do vectors of different lengths.  Repeated
    rows are rows of their own; a row with a null vec_id takes part, and its ``kept`` is
    false.  Other columns are not looked at.
    """
    nodes = stored(classes(vectors))
    graph, cut, start = sorted_blocks(nodes, spec, 0), None, 0
    best, stalled = -1.0, 0
    while True:
        graph, more = descend(graph, nodes, spec)
        cut = more if cut is None else cut.unionAll(more)
        linked, groups = enlarged(graph, cut, nodes, spec)
        linked = stored(linked)
        start += spec.sorts
        recall = audit(linked, nodes, spec, graph.filter(F.col("s") >= spec.threshold - spec.margin))
        if recall >= spec.recall:
            break
        best, stalled = max(best, recall), 0 if recall > best else stalled + 1
        if stalled >= spec.rounds:
            raise RuntimeError(f"recall {recall:.4f} is below {spec.recall} after {start} sorts, "
                               f"the last {spec.rounds * spec.sorts} without gain")
        graph = graph.unionAll(sorted_blocks(nodes, spec, start))
    heads = nodes.select("node", "n", "first_id")
    found = (heads.join(linked, "node", "left")
             .join(groups, heads["node"] == groups["id"], "left")
             .select("node", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
                     "first_id", F.coalesce("component", "node").alias("component")))
    least = found.groupBy("component").agg(F.min("first_id").alias("component_id"))
    result = stored(found.join(least, "component").select("node", "n_links", "component_id"))
    doubles, usable = _components()
    rows = vectors.select("vec_id", F.when(usable, F.xxhash64(doubles)).alias("node"))
    rows = rows.join(result, "node", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       component.alias("component_id"),
                       F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
