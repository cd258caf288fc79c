"""SimHash near-duplicates: fingerprints, and a binary trie joined with itself.

A fingerprint has 64 bits; a bit is set if more than half of the text's word shingles have
it set in their XXH64.  Equal fingerprints are one leaf of a binary trie.  To find all
pairs within a Hamming budget the trie is traversed in pairs of nodes, from the pair
(root, root) downwards: bits in which the two paths differ are summed up, and a pair is
dropped as soon as the sum exceeds the budget.

The upper part of the traversal is done with joins on tables of nodes and their counts: a
pair goes down a few levels at a time until both of its nodes together hold few enough
leaves for one task, however dense the region is.  Then the leaves of each pair are sent
to a task, where the lower part is traversed level by level on sorted arrays.  A
fingerprint has at most 2 080 others within two bits, so results grow in proportion.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
#: For each byte value its bits, the highest first.
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float64)


@dataclass(frozen=True)
class SimHash:
    """Shingle width in words, Hamming budget, and the leaves that a task may get."""

    width: int = 3
    budget: int = 2
    seed: int = 42
    first_depth: int = 6
    step: int = 3
    task_leaves: int = 16_384


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of the A-Z-lower-cased text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begins = np.concatenate([[0], np.cumsum(sizes)])
    ends = (begins[width:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(begins.tolist(), ends, strict=False)],
                    np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
    octets += np.arange(8) * 256
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (counts.ravel() * 2 > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, spec: SimHash) -> DataFrame:
    """doc_id and the fingerprint of the whole text as a signed long."""
    width, seed = spec.width, spec.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t, width, seed)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())],
                                             ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def node_prefix(fp: Column, depth: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - depth)


def _nodes(leaves: DataFrame, depth: int) -> DataFrame:
    return leaves.groupBy(node_prefix(F.col("fp"), depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))


def _masks(depth: int, budget: int) -> list[int]:
    """All differences of two prefixes that the budget allows."""
    out = [0]
    for _ in range(budget):
        out = sorted({m ^ (1 << i) for m in out for i in range(depth)} | set(out))
    return out


def node_pairs(leaves: DataFrame, spec: SimHash, fixed: int = 0, most: int = BITS, roots: int = 1
               ) -> list[tuple[int, DataFrame]]:
    """The upper traversal: for some depths, the node pairs (a, b, a <= b) that tasks take over.

    The first step goes from the roots to ``first_depth`` levels down (more where even
    evenly spread leaves would not fit): a node's partners follow from the differences
    that the budget allows.  Pairs that hold too many leaves go down further, children
    with children.  The first ``fixed`` bits tell apart ``roots`` tries, which do not meet;
    bits behind the first ``most`` are not used.
    """
    n = leaves.count() // roots << fixed
    depth = spec.first_depth
    while n >> depth > spec.task_leaves // 4 and depth < most:
        depth += 1
    nodes = _nodes(leaves, depth)
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(depth - fixed, spec.budget)])
    other = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = (nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.explode(masks).alias("mask"))
             .withColumn("b", F.col("a").bitwiseXOR(F.col("mask"))).filter("a <= b").join(other, "b")
             .select("a", "b", "na", "nb"))
    out = []
    while True:
        pairs = stored(pairs)
        small = (F.col("na") + F.col("nb") <= spec.task_leaves) if depth < most else F.lit(True)
        out.append((depth, pairs.filter(small).select("a", "b")))
        large = pairs.filter(~small)
        if large.isEmpty():
            return out
        step = min(spec.step, most - depth)
        depth += step
        child = _nodes(leaves, depth).withColumn("up", F.shiftrightunsigned("node", step))
        left = child.select(F.col("up").alias("a"), F.col("node").alias("ca"), F.col("n").alias("na"))
        right = child.select(F.col("up").alias("b"), F.col("node").alias("cb"), F.col("n").alias("nb"))
        differ = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")))
        pairs = (large.select("a", "b").join(left, "a").join(right, "b")
                 .filter((differ <= spec.budget) & (F.col("ca") <= F.col("cb")) | (F.col("a") != F.col("b")))
                 .filter(differ <= spec.budget)
                 .select(F.col("ca").alias("a"), F.col("cb").alias("b"), "na", "nb"))


def close_pairs(left: np.ndarray, right: np.ndarray, depth: int, budget: int,
                block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """The lower traversal: all (i, j) with left[i] and right[j] within ``budget`` bits.

    Both arrays are sorted and unsigned, each with one common prefix of ``depth`` bits.  A
    node is a range of an array.  All node pairs of a level go down together; what grows
    beyond ``block`` is put aside in halves.
    """
    differ = int(left[0] ^ right[0]) >> (BITS - depth) if depth else 0
    todo = [(depth, np.array([[0, len(left), 0, len(right), differ.bit_count()]], np.int64))]
    found = []
    while todo:
        depth, pairs = todo.pop()
        if len(pairs) > block:
            half = len(pairs) // 2
            todo += [(depth, pairs[:half]), (depth, pairs[half:])]
            continue
        # Few leaves on both sides are compared outright.
        few = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 16
        if depth >= BITS:
            few[:] = True
        for a in range(16):
            some = pairs[few]
            some = some[some[:, 0] + a < some[:, 1]]
            if not len(some):
                break
            for b in range(int((some[:, 3] - some[:, 2]).max())):
                each = some[some[:, 2] + b < some[:, 3]]
                i, j = each[:, 0] + a, each[:, 2] + b
                near = np.bitwise_count(left[i] ^ right[j]) <= budget
                found.append(np.stack([i[near], j[near]]))
        pairs = pairs[~few]
        if not len(pairs):
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        cut = []
        for array, lo in ((left, 0), (right, 2)):
            first = array[pairs[:, lo]]
            mask = ~np.uint64((1 << (BITS - depth)) - 1) if depth else np.uint64(0)
            middle = np.searchsorted(array, (first & mask) | bit)
            cut.append(np.clip(middle, pairs[:, lo], pairs[:, lo + 1]))
        l0, l1, r0, r1, d = pairs.T
        ways = [(l0, cut[0], r0, cut[1], d), (cut[0], l1, cut[1], r1, d),
                (l0, cut[0], cut[1], r1, d + 1), (cut[0], l1, r0, cut[1], d + 1)]
        below = np.concatenate([np.stack(w, axis=1) for w in ways])
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]
        if len(below):
            todo.append((depth + 1, below))
    i, j = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    return i, j


def _cell_task(depth: int, budget: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The lower traversal of one node pair: its leaves in, links out."""
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        fp = cell["fp"].to_numpy().view(np.uint64)
        own = (cell["node"] == cell["a"]).to_numpy()
        left = np.sort(fp[own])
        right = left if own.all() else np.sort(fp[~own])
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        i, j = close_pairs(left, right, depth, budget)
        if right is left:
            i, j = i[i < j], j[i < j]
        return pd.DataFrame({"a": left[i].view(np.int64), "b": right[j].view(np.int64)})
    return run


def links(leaves: DataFrame, spec: SimHash) -> DataFrame:
    """All pairs (a, b) of different fingerprints within the budget, each once."""
    parts = []
    for depth, pairs in node_pairs(leaves, spec):
        sides = pairs.select(F.explode(F.when(F.col("a") == F.col("b"), F.array("a"))
                                       .otherwise(F.array("a", "b"))).alias("node"), "a", "b")
        cells = leaves.withColumn("node", node_prefix(F.col("fp"), depth)).join(sides, "node")

        parts.append(cells.groupBy("a", "b").applyInPandas(_cell_task(depth, spec.budget), "a long, b long"))
    return reduce(DataFrame.unionAll, parts)


def near_duplicates(docs: DataFrame, spec: SimHash = SimHash()) -> DataFrame:  # noqa: B008
    """Fingerprint and component of every document: doc_id, fingerprint, component_id.

    ``fingerprint`` is in 16 lowercase hexadecimal digits.  ``component_id`` is the least
    doc_id that is reachable over fingerprints within the budget.  Texts without words,
    null ones included, have fingerprint zero and link like any other.  Documents with a
    null doc_id keep their row; a component without any id has a null one.  Repeated rows
    are each returned.  Other columns are not looked at.
    """
    rows = stored(fingerprints(docs, spec))
    leaves = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(links(leaves.select("fp"), spec))
    found = leaves.join(linked, leaves["fp"] == linked["id"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = found.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = stored(found.join(least, "component").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           "component_id")

