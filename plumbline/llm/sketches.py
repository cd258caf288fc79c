"""SimHash near-duplicates by similarity, for texts that differ in more than a few bits.

Two texts that share four fifths of their shingles differ in a sixth of their SimHash bits,
far more than one trie join can bridge.  Each text gets several independent fingerprints of
64 bits.  A trie is built over the first bits of each half, its sketch, and joined with itself
under a small budget of differing bits: near-duplicates meet in at least one of the tries.
A pair that met is a candidate if few enough bits of two other fingerprints differ; the
Jaccard similarity of its distinct shingles decides.

A trie that is too large for one task is cut without loss.  Its bits fall into more segments
than the budget has errors, so a pair within the budget agrees in some of them.  The trie is
built once for each choice of these, with their bits first: node pairs that differ in them
need not be visited, and each node is a task of its own.

Only what keeps groups together is handed on.  A task of the trie join compares candidates by
their bits and returns a spanning forest of those that pass; texts of the groups that these tie
together are compared exactly, tile by tile, and tiles return spanning forests as well.  So
links grow with the documents, not with the square of a group.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import hashable, join_summary, stored
from .common import trim
from .components import components

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Nodes of up to so many leaves are compared outright.
SMALL = 1024

#: The share of all bits in which two texts may differ to be compared exactly.
ALL_LIMIT = 0.25


@dataclass(frozen=True)
class Sketches:
    """Shingle width, number of tries, bits of a sketch, and the budget within it.  Each
    fingerprint of 64 bits serves two tries, with its first and second half.

    Near-duplicates have a Jaccard ``similarity`` of distinct shingles.  ``limit`` is the share
    of the bits of two fingerprints in which candidates may differ.  Sets of Jaccard similarity s have a cosine
    of 2s / (1 + s), and differ in the share acos(cosine) / pi of their bits: 0.152 for 0.8,
    up to 0.19 for sets of a few shingles.  ``tile`` is the number of texts compared at once,
    ``task_leaves`` what a task of the trie join takes.
    """

    width: int = 5
    tries: int = 16
    bits: int = 24
    budget: int = 2
    limit: float = 0.28
    similarity: float = 0.8
    tile: int = 256
    seed: int = 42
    task_leaves: int = 32_768

    @property
    def words(self) -> int:
        return -(-self.tries // 2)


class WordHashes(dict):
    """The hash of every word, computed once; forgotten when there are very many."""

    def __init__(self, seed: int, most: int = 300_000) -> None:
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def shingles(self, text: str | None, width: int) -> np.ndarray:
        """The hashes of the distinct shingles of the A-Z-lower-cased text, sorted; of all its words
        if they are fewer than a shingle has.  They are made of word hashes, so no shingle is spelt out."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self) > self.most:
            self.clear()
        hashes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        width = min(width, len(words))
        n = len(words) - width + 1
        out = np.full(n, len(words) if n == 1 else 0, np.uint64)
        for i in range(width):
            out = (out ^ hashes[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def many_fingerprints(hashes: np.ndarray, n: int) -> list[int]:
    """``n`` independent fingerprints, of hashes that are mixed anew for each: bits set in more
    than half of them."""
    odd = np.arange(n, dtype=np.uint64) * np.uint64(2 * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + np.uint64(1)
    counts = np.zeros(64 * n, np.int64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at:at + 4096, None] * odd[None, :]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(len(mixed), -1), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(hashes)).view(">i8").tolist()


def sketched(rows: DataFrame, spec: Sketches) -> DataFrame:
    """id and its fingerprints for (id, text); texts without words are left out."""
    width, seed, words = spec.width, spec.seed, spec.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(seed)
        for batch in batches:
            some, found = [], []
            for i, text in enumerate(batch.column("text")):
                hashes = known.shingles(text.as_py(), width)
                if len(hashes):
                    some.append(i)
                    found.append(many_fingerprints(hashes, words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(some, pa.int64())), pa.array(found, pa.list_(pa.int64()))],
                ["id", "fps"])
        known.clear()
        trim()

    return rows.select("id", "text").mapInArrow(run, "id long, fps array<long>")


def _tie(comp: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after the links (x, y), and which of these form a spanning forest of what they add."""
    used = []
    while True:
        low, high = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
        apart = np.flatnonzero(low != high)
        if not len(apart):
            return comp, np.concatenate([np.zeros(0, np.int64), *used])
        first = apart[np.unique(high[apart], return_index=True)[1]]
        used.append(first)
        to = np.arange(len(comp))
        to[high[first]] = low[first]
        while (to[to] != to).any():
            to = to[to]
        comp = to[comp]


def _apart(fps: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[x] ^ fps[y]).sum(axis=1, dtype=np.int64)


def near_leaves(left: np.ndarray, right: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with left[i] and right[j] within ``budget`` bits, for sorted 32-bit leaves that
    agree in their first ``depth`` bits; i <= j if both are the same array.

    Node pairs go down together, with the bits in which they differ so far, and are dropped
    beyond the budget.  Small nodes are compared outright.
    """
    found = []
    todo = [(0, len(left), 0, len(right), depth, 0)]
    while todo:
        a, b, c, d, at, apart = todo.pop()
        if a == b or c == d:
            continue
        if at == 32 or max(b - a, d - c) <= SMALL:
            for lo in range(a, b, SMALL):
                hit = np.bitwise_count(left[lo:min(b, lo + SMALL), None] ^ right[None, c:d]) <= budget
                i, j = np.nonzero(hit)
                found.append((i + lo, j + c))
            continue
        bit = np.uint32(1 << (31 - at))
        high = np.uint32((left[a] >> np.uint32(32 - at) << np.uint32(32 - at)) | bit) if at else bit
        other = np.uint32((right[c] >> np.uint32(32 - at) << np.uint32(32 - at)) | bit) if at else bit
        m, n = a + int(np.searchsorted(left[a:b], high)), c + int(np.searchsorted(right[c:d], other))
        todo += [(a, m, c, n, at + 1, apart), (m, b, n, d, at + 1, apart)]
        if apart < budget:
            todo.append((a, m, n, d, at + 1, apart + 1))
            if left is not right or a != c:
                todo.append((m, b, c, n, at + 1, apart + 1))
    i, j = (np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*found, strict=True)) if found else (
        np.zeros(0, np.int64), np.zeros(0, np.int64))
    return (i[i <= j], j[i <= j]) if left is right else (i, j)


def _forest(agree: int, budget: int, most: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The traversal of a node of a trie, or of a pair of its parts: texts whose sketches agree in
    their first ``agree`` bits and meet are compared by the bits of two other fingerprints, and
    a spanning forest of the pairs within ``most`` bits is returned."""
    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        i_part, j_part = (int(k) for k in key[1:])
        own = cell["part"].to_numpy() == i_part
        order = np.lexsort((cell["leaf"].to_numpy().view(np.uint64), ~own))
        leaf, ids, own = cell["leaf"].to_numpy().view(np.uint64)[order], cell["id"].to_numpy()[order], own[order]
        fps = np.column_stack([cell["x"].to_numpy()[order], cell["y"].to_numpy()[order]]).view(np.uint64)
        begins = np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (own[1:] != own[:-1])))
        ends = np.append(begins[1:], len(leaf))
        cut = int(own[begins].sum())
        whole = i_part == j_part
        if not cut or not whole and cut == len(begins):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        short = (leaf[begins] >> np.uint64(32)).astype(np.uint32)
        prefix = short >> np.uint32(32 - agree) if agree else np.zeros(len(short), np.uint32)
        pairs = []
        borders = np.flatnonzero(np.append(True, prefix[1:cut] != prefix[:cut - 1])).tolist()
        for a, b in zip(borders, [*borders[1:], cut], strict=True):
            if whole:
                near = near_leaves(block := short[a:b], block, agree, budget)
                pairs.append((near[0] + a, near[1] + a))
            else:
                c, d = (cut + int(np.searchsorted(prefix[cut:], prefix[a], side)) for side in ("left", "right"))
                near = near_leaves(short[a:b], short[c:d], agree, budget)
                pairs.append((near[0] + a, near[1] + c))
        i, j = (np.concatenate(side) for side in zip(*pairs, strict=True))
        # A sketch meets itself only if several texts have it.
        fine = (i != j) | (ends[i] - begins[i] > 1)
        i, j = i[fine], j[fine]
        comp, out = np.arange(len(ids)), []

        def test(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal comp
            new = comp[x] != comp[y]
            x, y = x[new], y[new]
            near = _apart(fps, x, y) <= most
            x, y = x[near], y[near]
            comp, used = _tie(comp, x, y)
            out.append((ids[x[used]], ids[y[used]]))

        # The first texts of equal sketches come first; what they have tied together is not
        # looked at again.
        if whole:
            test(np.repeat(begins, ends - begins), np.arange(len(ids)))
        for at in range(0, len(i), 1 << 18):
            test(begins[i[at:at + (1 << 18)]], begins[j[at:at + (1 << 18)]])
        one = np.minimum.reduceat(comp, begins) == np.maximum.reduceat(comp, begins)
        open_ = ~(one[i] & one[j] & (comp[begins[i]] == comp[begins[j]]))
        i, j = i[open_], j[open_]
        for at in range(0, len(i), 4096):
            some, other = i[at:at + 4096], j[at:at + 4096]
            n = ends[some] - begins[some]
            x = np.repeat(begins[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            other = np.repeat(other, n)
            size = ends[other] - begins[other]
            last = np.cumsum(size)
            lo = 0
            while lo < len(x):
                hi = max(lo + 1, int(np.searchsorted(last, last[lo] - size[lo] + (1 << 18), "right")))
                n = size[lo:hi]
                y = np.repeat(begins[other[lo:hi]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                test(np.repeat(x[lo:hi], n), y)
                lo = hi
        a, b = (np.concatenate(side) for side in zip(*out, strict=True)) if out else (ids[:0], ids[:0])
        return pd.DataFrame({"a": a, "b": b})
    return run


def tries_of(spec: Sketches, leaves: int) -> tuple[int, int, list[list[tuple[int, int]]]]:
    """How many bits tell the nodes of a trie with ``leaves`` leaves apart, in how many first
    bits the sketches agree that an order has to bring together, and the orders of
    bits, as (first bit, number of bits) runs from the highest on.

    With j segments more than the budget, two sketches within it agree in j of them at least.
    j is as large as it takes for a choice of j segments to have enough bits.
    """
    depth = max(0, (max(leaves, 1) - 1) // spec.task_leaves).bit_length()
    if not depth:
        return 0, 0, [[(0, spec.bits)]]
    for j in range(1, spec.bits - spec.budget + 1):
        count = spec.budget + j
        borders = [spec.bits * i // count for i in range(count + 1)]
        runs = [(a, b - a) for a, b in zip(borders, borders[1:], strict=False)]
        least = min(sum(runs[i][1] for i in chosen) for chosen in combinations(range(count), j))
        if least >= depth or comb(count, j) > 200:
            break
    return min(depth, least), least, [[runs[i] for i in chosen] + [r for i, r in enumerate(runs) if i not in chosen]
                                      for chosen in combinations(range(count), j)]


def _reordered(sketch: np.ndarray, runs: list[tuple[int, int]], bits: int) -> np.ndarray:
    """Sketches with their runs of bits in the given order, as the highest bits of a word."""
    out, at = np.zeros(len(sketch), np.uint64), 64
    for first, n in runs:
        at -= n
        part = (sketch >> np.uint64(bits - first - n)) & np.uint64((1 << n) - 1)
        out |= part << np.uint64(at)
    return out


def _leaves(heads: DataFrame, spec: Sketches, depth: int, orders: list[list[tuple[int, int]]]) -> DataFrame:
    """A leaf of every text in every trie: id, node, leaf, and two other fingerprints, x and y."""
    tries, bits, words = spec.tries, spec.bits, spec.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            fps = batch.column("fps").flatten().to_numpy().view(np.uint64).reshape(n, words)
            for t in range(tries):
                sketch = (fps[:, t // 2] >> np.uint64(64 - 32 * (t % 2) - bits)) & np.uint64((1 << bits) - 1)
                x, y = (pa.array(fps[:, (t // 2 + k) % words].view(np.int64)) for k in (1, 2))
                for o, runs in enumerate(orders):
                    leaf = _reordered(sketch, runs, bits)
                    node = np.full(n, (t * len(orders) + o) << depth, np.int64)
                    if depth:
                        node += (leaf >> np.uint64(64 - depth)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id"), pa.array(node), pa.array(leaf.view(np.int64)), x, y],
                        ["id", "node", "leaf", "x", "y"])

    return heads.select("id", "fps").mapInArrow(run, "id long, node long, leaf long, x long, y long")


def loose_links(rows: DataFrame, spec: Sketches) -> DataFrame:
    """Links (a, b) that tie together all texts that met and differ in few enough bits."""
    # Texts with all bits equal are tied to one of them.
    heads = stored(rows.groupBy("fps").agg(F.min("id").alias("id")))
    same = rows.join(heads.select("fps", F.col("id").alias("b")), "fps").select(F.col("id").alias("a"), "b")
    depth, agree, orders = tries_of(spec, heads.count())
    each = _leaves(heads, spec, depth, orders)
    # A node that holds far more than its share, as texts of one sketch do, is dealt into parts,
    # which meet pair by pair.
    parts = F.ceil(F.col("n") / (4 * spec.task_leaves)).cast("int")
    large = each.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * spec.task_leaves).select(
        "node", parts.alias("parts"))
    dealt = join_summary(each, large, ["node"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cells = dealt.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "id", "leaf", "x", "y", "part", "node", F.least("part", "other").alias("i"),
        F.greatest("part", "other").alias("j"))
    most = int(spec.limit * 128)
    met = cells.groupBy("node", "i", "j").applyInPandas(_forest(agree, spec.budget, most), "a long, b long")
    return same.filter("a <> b").unionAll(met)


def _decide(spec: Sketches) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """All pairs of a pair of tiles that are not yet tied, by the Jaccard similarity of their
    distinct shingle hashes: a spanning forest of those that reach ``spec.similarity``."""
    width, seed, least, most = spec.width, spec.seed, spec.similarity, int(ALL_LIMIT * 64 * spec.words)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        ids, texts = cell["id"].to_numpy(), cell["text"].to_list()
        fps = np.stack(cell["fps"].to_list()).astype(np.int64, copy=False).view(np.uint64)
        comp = np.unique(cell["tied"].to_numpy(), return_inverse=True)[1]
        tile = cell["tile"].to_numpy()
        alone = bool((tile == tile[0]).all())
        if alone and (cell["i"] != cell["j"]).any():
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        sets: dict[int, np.ndarray] = {}
        known = WordHashes(seed)

        def of(at: int) -> np.ndarray:
            if at not in sets:
                sets[at] = known.shingles(texts[at], width)
            return sets[at]

        out = []
        for x in range(len(ids)):
            others = np.arange(x + 1, len(ids))
            others = others[(comp[others] != comp[x]) & (alone | (tile[others] != tile[x]))]
            others = others[_apart(fps, np.full(len(others), x), others) <= most]
            for y in others.tolist():
                if comp[y] == comp[x]:
                    continue
                a, b = of(x), of(y)
                if min(len(a), len(b)) < least * max(len(a), len(b)):
                    continue
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common >= least * (len(a) + len(b) - common):
                    comp[comp == comp[y]] = comp[x]
                    out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
    return run


def near_links(rows: DataFrame, texts: DataFrame, spec: Sketches) -> DataFrame:
    """Links (a, b) between ids that hold; enough of them to keep every found group together.

    All texts of a loose group (tied by few enough differing bits) are compared in tiles.
    Tiles are first compared with themselves and the next one.  What that has tied together
    is not compared again: tiles of one such part do not meet each other, tiles of others do.
    """
    groups = stored(components(loose_links(rows, spec)).withColumnRenamed("component", "loose"))
    each = stored(texts.join(groups, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")))
    full = stored(rows.join(groups, "id").join(each, "id"))

    def met(tiled: DataFrame, pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
        sides = pairs.select(F.explode(F.when(F.col("i") == F.col("j"), F.array("i"))
                                       .otherwise(F.array("i", "j"))).alias("tile"), "i", "j")
        cells = tiled.join(full, "id").join(sides, "tile").select("id", "fps", "text", "tied", "tile", "i", "j")
        return stored(cells.groupBy("i", "j").applyInPandas(_decide(spec), "a long, b long"))

    def number(size: Column) -> Column:
        return F.ceil(size / spec.tile).cast("long")

    sizes = stored(groups.groupBy("loose").agg(number(F.count(F.lit(1))).alias("tiles")))
    tiled = groups.join(sizes, "loose").select("id", F.col("id").alias("tied"), F.xxhash64(
        "loose", F.pmod(F.xxhash64("id"), F.col("tiles"))).alias("tile"))
    ring = sizes.select("loose", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("t"))
    i, j = F.xxhash64("loose", "t"), F.xxhash64("loose", (F.col("t") + 1) % F.col("tiles"))
    found = met(tiled, ring.select(i.alias("i"), F.explode(F.array(i, j)).alias("j")))
    large = groups.join(sizes.filter("tiles > 1"), "loose", "left_semi")
    if large.isEmpty():
        return found
    tied = components(found).withColumnRenamed("component", "tied")
    large = stored(large.join(tied, "id", "left").select("id", "loose", F.coalesce("tied", "id").alias("tied")))
    part = large.groupBy("loose", "tied").agg(F.count(F.lit(1)).alias("size")).withColumn(
        "whole", F.col("size") >= spec.tile)
    rest = part.filter("NOT whole").groupBy("loose").agg(number(F.sum("size")).alias("pools"))
    part = stored(part.join(rest, "loose", "left"))
    key = F.when(F.col("whole"), F.xxhash64("loose", "tied", F.pmod(F.xxhash64("id"), number(F.col("size"))))
                 ).otherwise(F.xxhash64("loose", F.pmod(F.xxhash64("id", F.lit(1)), F.col("pools")), F.lit("pool")))
    placed = stored(large.join(part, ["loose", "tied"]).select(
        "id", "loose", "tied", key.alias("tile"), F.when(F.col("whole"), F.col("tied")).alias("only")))
    tiles = placed.select("loose", "tile", "only").distinct()
    pairs = (tiles.select("loose", F.col("tile").alias("i"), F.col("only").alias("p"))
             .join(tiles.select("loose", F.col("tile").alias("j"), F.col("only").alias("q")), "loose")
             .filter("i <= j AND NOT coalesce(p = q, false)"))
    return found.unionAll(met(placed.select("id", "tied", "tile"), pairs))


def keep_one(docs: DataFrame, spec: Sketches = Sketches()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` with one row of each near-duplicate group: the least doc_id's.

    Equal texts are one group.  Texts without words, null ones included, are one group as
    well.  A group without any id, and rows that share the least id, keep one row, chosen
    by a hash of all columns.  Columns may have any names but those beginning with ``sim_``.
    """
    content = F.xxhash64(*hashable(docs))
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    slim = docs.select(text.alias("id"), F.struct(F.col("doc_id").isNull().alias("none"),
                                                  F.col("doc_id").alias("doc"), content.alias("row")).alias("head"))
    texts = slim.groupBy("id").agg(F.min("head").alias("head"))
    rows = stored(sketched(docs.select(text.alias("id"), "text"), spec).dropDuplicates(["id"]))
    # Texts without words share one class, whatever white space they hold.
    linked = components(near_links(rows, docs.select(text.alias("id"), "text"), spec))
    known = stored(texts).join(rows.select(F.col("id").alias("sim_some")), F.col("id") == F.col("sim_some"), "left")
    known = known.join(linked.withColumnRenamed("id", "sim_id"), F.col("id") == F.col("sim_id"), "left")
    group = F.when(F.col("sim_some").isNull(), F.lit(0)).otherwise(F.coalesce("component", "id"))
    heads = stored(known.groupBy(group.alias("sim_group"), F.col("sim_some").isNull().alias("sim_none"))
                   .agg(F.min("head").alias("head"))
                   .select(F.col("head.doc").alias("sim_doc"), F.col("head.row").alias("sim_row")))
    same = docs["doc_id"].eqNullSafe(F.col("sim_doc")) & (content == F.col("sim_row"))
    first = F.row_number().over(W.partitionBy("sim_doc", "sim_row").orderBy(F.lit(0)))
    kept = docs.join(heads, same).withColumn("sim_rank", first)
    return kept.filter("sim_rank = 1").select(*docs.columns)
