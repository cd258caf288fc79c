"""The prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns.  It is named by a running sum of hashes, one
per turn and place, modulo 2**32 in four parts; sums run over blocks of places first, so that
one long conversation spreads over tasks.  Nodes come from one aggregation over all turns.

Totals of subtrees flow from the leaves to the root.  Nodes are sorted externally in reverse
level order, so every node stands behind all its children; it takes what they have sent it
out of a priority queue and sends its own total to its parent through the same queue, which
spills to sorted runs.  This goes on within shards first.  How many turns lie below a node is
known beforehand from its members, so nodes are told apart:

* below a *light* node lie few turns.  Each largest light subtree is a shard, or a part of
  one: all of it is in one task, and nothing comes in from outside;
* *heavy* nodes are the top of the trie.  Their paths are cut into segments of a bounded number
  of levels.  There are few: about all turns over the turns of a shard, and the square
  root of all turns.  The totals of segments go through one queue across all segments; with
  them, every segment passes its totals on once more.

Nothing is collected to the driver but counts.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import sys
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import ranked
from ..session import join_summary, stored

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = 4
NODE = ["depth", "k0", "k1"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Sharding:
    """Sizes of shards.  A light subtree has at most ``turns`` turns, or the given share of
    all turns if that is more; a heavy segment has ``levels`` levels; running sums take
    ``block`` places at a time; children of one parent are dealt over ``salts`` keys; a queue
    holds ``queue`` messages in memory, and a chunk of ids ``ids``."""

    turns: int = 256
    share: float = 2 ** -16
    levels: int = 2048
    block: int = 4096
    salts: int = 1024
    queue: int = 200_000
    ids: int = 4096


class SpillingQueue:
    """A priority queue of (key, leaves, saved) that holds at most ``limit`` messages in
    memory; beyond that the held ones are written to a sorted run in the task's scratch space."""

    def __init__(self, limit: int, fan: int = 32) -> None:
        self.limit, self.fan = limit, fan
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []   # a heap of (next message, number, reader)
        self.made = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self._spill(iter(sorted(self.heap)))
            self.heap = []
            if len(self.runs) > self.fan:
                held, self.runs = self.runs, []
                self._spill(heapq.merge(*[chain([first], reader) for first, _, reader in held]))

    def _spill(self, messages: Iterator[tuple]) -> None:
        scratch = tempfile.TemporaryFile()  # noqa: SIM115: the reader closes it
        block: list[tuple] = []
        for message in messages:
            block.append(message)
            if len(block) >= 4096:
                pickle.dump(block, scratch)
                block = []
        pickle.dump(block, scratch)
        pickle.dump(None, scratch)
        scratch.seek(0)

        def reader() -> Iterator[tuple]:
            with scratch:
                while (block := pickle.load(scratch)) is not None:
                    yield from block
        each = reader()
        if (first := next(each, None)) is not None:
            self.made += 1
            heapq.heappush(self.runs, (first, self.made, each))

    def least(self) -> tuple | None:
        """The message with the least key; it stays in the queue."""
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            first, number, each = self.runs[0]
            if (new := next(each, None)) is not None:
                heapq.heapreplace(self.runs, (new, number, each))
            else:
                heapq.heappop(self.runs)
            return first
        return heapq.heappop(self.heap)


def forward(batches: Iterator[pa.RecordBatch], queue: SpillingQueue) -> Iterator[pa.RecordBatch]:
    """Totals instead of own values, for nodes in reverse level order shard by shard.

    A node is known in its shard by (level, node) and has its parent at (up_level, up_node)
    of the same shard if it is ``inside``.  ``leaves`` and ``saved`` become sums over all
    nodes of the shard below and the node itself; other columns stay.
    """
    shard = None
    for batch in batches:
        given = [batch.column(c).to_pylist() for c in
                 ("shard", "level", "node", "up_level", "up_node", "inside", "leaves", "saved")]
        sums: list[tuple[int, int]] = []
        for own, level, node, up_level, up_node, inside, leaves, saved in zip(*given, strict=True):
            if own != shard:
                if queue.least() is not None:
                    raise RuntimeError("a parent is missing in its shard")
                shard = own
            key = (-level, node)
            while (first := queue.least()) is not None and first[0] == key:
                _, more, most = queue.pop()
                leaves, saved = leaves + more, saved + most
            if inside:
                queue.push(((-up_level, up_node), leaves, saved))
            sums.append((leaves, saved))
        arrays = dict(zip(batch.schema.names, batch.columns, strict=True))
        for i, name in enumerate(("leaves", "saved")):
            arrays[name] = pa.array([s[i] for s in sums], pa.int64())
        yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))
    if queue.least() is not None:
        raise RuntimeError("a parent is missing in its shard")


def _totals(nodes: DataFrame, by: list[str], sharding: Sharding, one: bool = False) -> DataFrame:
    limit = sharding.queue

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return forward(batches, SpillingQueue(limit))

    dealt = nodes.repartition(1) if one else nodes.repartition(*by)
    return dealt.sortWithinPartitions("shard", F.col("level").desc(), "node").mapInArrow(run, nodes.schema)


def share_heads(turns: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that groups of a hundred share their first turns.

    Conversation c gets the first h turns of conversation c - c % 100, then its own turns
    after its first h; h is crc32(c) % (most + 1), c in decimal.  Returns the turns
    (conv_id, place, role, text) and the conversations (conv_id, n: their number of turns).
    Turns are ordered by turn with null first, then by role and text; a null role or text is
    empty.  Rows without conv_id belong to no conversation.
    """
    clean = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(ranked(clean, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "text"], "at").drop("turn"))
    lengths = rows.groupBy("conv_id").agg(F.max("at").alias("own"))
    base = lengths.select(F.col("conv_id").alias("base"), F.least("own", F.lit(most)).alias("there"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    convs = lengths.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = stored(convs.join(base, "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    tails = join_summary(rows, convs.select("conv_id", "h", "taken"), ["conv_id"], "inner").filter("at > h").select(
        "conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("place"), "role", "text")
    # At most ``most`` rows of a base and a hundred conversations meet under one key.
    heads = rows.filter(F.col("at") <= most).withColumnRenamed("conv_id", "base").join(convs, "base").filter(
        "at <= h").select("conv_id", F.col("at").alias("place"), "role", "text")
    return tails.unionByName(heads), convs.select("conv_id", "n")


def _sum_key(sums: list[Column]) -> list[Column]:
    """Four sums as two words: the name of a sequence of turns, but for its length."""
    low = [F.pmod(s, F.lit(2 ** 32)) for s in sums]
    return [F.shiftleft(low[0], 32).bitwiseOR(low[1]).alias("k0"), F.shiftleft(low[2], 32).bitwiseOR(low[3]).alias("k1")]


def prefixes(turns: DataFrame, convs: DataFrame, sharding: Sharding) -> DataFrame:
    """One row per conversation and place: conv_id, depth, k0, k1 (the node), p0, p1 (its
    parent), size (code points of the turn's text), rest (turns from here on)."""
    body = F.concat(F.col("place").cast("string"), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"),
                    "role", "text")
    hashed = turns.select("conv_id", "place", F.length("text").cast("long").alias("size"), F.sha2(body, 256).alias("sha"))
    parts = [f"h{i}" for i in range(PARTS)]
    rows = stored(hashed.select(
        "conv_id", "place", "size", F.floor((F.col("place") - 1) / sharding.block).alias("block"),
        *[F.conv(F.substring("sha", 1 + 8 * i, 8), 16, 10).cast("long").alias(p) for i, p in enumerate(parts)]))
    # Sums of whole blocks in front of each block but the first.
    whole = rows.groupBy("conv_id", "block").agg(*[F.pmod(F.sum(p), F.lit(2 ** 32)).alias(p) for p in parts])
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = whole.select("conv_id", "block", *[F.sum(p).over(before).alias(f"o{i}") for i, p in enumerate(parts)])
    placed = join_summary(rows, offsets.filter("block > 0"), ["conv_id", "block"], "left", salts=1)
    inside = W.partitionBy("conv_id", "block").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    sums = [F.coalesce(f"o{i}", F.lit(0)) + F.sum(p).over(inside) for i, p in enumerate(parts)]
    summed = placed.select("conv_id", F.col("place").cast("long").alias("depth"), "size", *parts,
                           *[s.alias(f"s{i}") for i, s in enumerate(sums)])
    own, up = _sum_key([F.col(f"s{i}") for i in range(PARTS)]), _sum_key(
        [F.col(f"s{i}") - F.col(p) for i, p in enumerate(parts)])
    named = summed.select("conv_id", "depth", "size", *own, up[0].alias("p0"), up[1].alias("p1"))
    return join_summary(named, convs, ["conv_id"], "inner").select(
        *named.columns, (F.col("n") - F.col("depth") + 1).alias("rest"), (F.col("n") == F.col("depth")).alias("ends"))


def _parents(nodes: DataFrame, salts: int) -> DataFrame:
    """The nodes with the name of their parent (up_node).  A parent may have any number of
    children: they are dealt over ``salts`` keys, and each key that occurs gets the parent."""
    salt = F.pmod(F.xxhash64(*NODE), F.lit(salts)).cast("int")
    children = nodes.filter("depth > 0").select("*", (F.col("depth") - 1).alias("up_depth"), salt.alias("salt"))
    up = nodes.select(F.col("depth").alias("up_depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"),
                      F.col("node").alias("up_node"))
    key = ["up_depth", "p0", "p1"]
    dealt = children.select(*key, "salt").distinct().join(up, key)
    return children.join(dealt, [*key, "salt"]).drop("up_depth", "salt").unionByName(
        nodes.filter("depth = 0").withColumn("up_node", F.lit(None).cast("long")))


def _ends(ends: DataFrame, sharding: Sharding) -> DataFrame:
    """Per node that conversations end at, the digest of their ids.  Ids are sorted over all
    tasks and written into chunks; the digest, which no two tasks can share, reads chunks only."""
    size = sharding.ids

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, k0, k1, conv = (batch.column(c).to_numpy() for c in (*NODE, "conv_id"))
            new = (np.diff(depth) != 0) | (np.diff(k0) != 0) | (np.diff(k1) != 0)
            starts = np.flatnonzero(np.concatenate([[True], new])) if len(depth) else np.zeros(0, np.int64)
            starts = [s for a, b in zip(starts, [*starts[1:], len(depth)], strict=True) for s in range(a, b, size)]
            texts = [",".join(map(str, conv[a:b].tolist())) for a, b in
                     zip(starts, [*starts[1:], len(depth)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x[starts]) for x in (depth, k0, k1, conv)],
                                              pa.array(texts, pa.string())], [*NODE, "conv_id", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if key == now:
                    digest.update(b"," + ids.encode())
                else:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
            yield _digest_batch(done)
        if now is not None:
            yield _digest_batch([(*now, digest.hexdigest())])

    ordered = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    cut = ordered.mapInArrow(chunks, "depth long, k0 long, k1 long, conv_id long, ids string")
    return cut.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(
        digests, "depth long, k0 long, k1 long, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame, sharding: Sharding = Sharding()) -> DataFrame:  # noqa: B008
    """The nodes of the prefix trie of conversations.

    ``turns`` has conv_id, place (1, 2, ... in each conversation), role and text without
    nulls; ``convs`` every conv_id with its number of turns n, 0 for a turnless conversation.

    Returns per node: conv_id (its least member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256 (the digest of the sorted ids
    of members that end here).  Equal turns in a row are turns of their own.  Conversations
    that are copies of each other share all nodes.  Without any conversation there is no node.
    """
    rows = stored(prefixes(turns, convs, sharding))
    root = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.sum("n").alias("below")) \
        .filter("n_convs > 0").select(
            *[F.lit(0).cast("long").alias(c) for c in (*NODE, "p0", "p1")], "node", "n_convs",
            F.lit(0).cast("long").alias("size"), "below")
    named = rows.groupBy(*NODE).agg(
        F.min("p0").alias("p0"), F.min("p1").alias("p1"), F.min("conv_id").alias("node"), F.count("*").alias("n_convs"),
        F.max("size").alias("size"), F.sum("rest").alias("below"))
    named = stored(root.unionByName(named))
    total = convs.agg(F.sum("n")).first()[0] or 0
    most = max(sharding.turns, int(total * sharding.share))
    children = named.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"),
                                                 F.col("p1").alias("k1")).agg(F.count("*").alias("n_children"))
    nodes = _parents(named, sharding.salts).join(children, NODE, "left").select(
        *NODE, "p0", "p1", "node", F.col("depth").alias("level"), (F.col("depth") - 1).alias("up_level"), "up_node",
        "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
        ((F.col("below") > most) | (F.col("depth") == 0)).alias("heavy"))
    nodes = stored(nodes)
    light, outside = _light(rows, nodes, sharding)
    columns = [*NODE, "node", "up_node", "n_convs", "n_children", "leaves", "saved"]
    heavy = _heavy(nodes.filter("heavy"), outside, sharding)
    both = light.select(*columns).unionByName(heavy.select(*columns))
    ends = rows.filter("ends").select(*NODE, "conv_id").unionByName(
        convs.filter("n = 0").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id"))
    return both.join(_ends(ends, sharding), NODE, "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("up_node").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def _light(rows: DataFrame, nodes: DataFrame, sharding: Sharding) -> tuple[DataFrame, DataFrame]:
    """Totals of all light nodes, and what their topmost ones send to heavy parents."""
    top = nodes.filter("heavy AND depth > 0").select(*NODE, F.lit(True).alias("heavy"))
    free = F.when(F.col("heavy").isNull(), F.struct(*NODE))
    tops = join_summary(rows.select("conv_id", *NODE), top, NODE, "left").groupBy(
        F.col("conv_id").alias("node")).agg(F.min(free).alias("top"))
    marked = join_summary(nodes.filter("NOT heavy"), tops, ["node"], "inner")
    sharded = marked.select(
        *[c for c in marked.columns if c != "top"], F.concat_ws(":", "top.depth", "top.k0", "top.k1").alias("shard"),
        (F.col("depth") > F.col("top.depth")).alias("inside"))
    done = stored(_totals(sharded, ["shard"], sharding))
    out = done.filter("NOT inside").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"),
                                            F.col("p1").alias("k1")).agg(
        F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))
    return done, out


def _heavy(nodes: DataFrame, outside: DataFrame, sharding: Sharding) -> DataFrame:
    """Totals of all heavy nodes, given what light subtrees send them."""

    def plus(table: DataFrame, messages: DataFrame, key: list[str]) -> DataFrame:
        return table.join(messages, key, "left").withColumns(
            {c: F.col(c) + F.coalesce(f"in_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("in_leaves", "in_saved")

    part = F.floor(F.col("depth") / sharding.levels)
    own = stored(plus(nodes, outside, NODE).withColumn("part", part))
    segments = own.groupBy("node", "part").agg(
        F.min("depth").alias("level"), F.min_by("up_node", "depth").alias("up_node"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    segments = stored(segments.select("*", F.floor((F.col("level") - 1) / sharding.levels).alias("up_part")))
    tops = segments.select(F.col("node").alias("up_node"), F.col("part").alias("up_part"), F.col("level").alias("up_level"))
    linked = segments.join(tops, ["up_node", "up_part"], "left").select(
        "node", "level", "up_node", "up_level", "leaves", "saved", F.lit("").alias("shard"),
        F.col("up_level").isNotNull().alias("inside"))
    # The segments of all shards: a bounded number, see above.
    across = _totals(linked, [], sharding, one=True)
    sent = across.filter("inside").groupBy(F.col("up_node").alias("node"), (F.col("level") - 1).alias("depth")).agg(
        F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))
    again = plus(own, sent, ["node", "depth"]).select(
        *own.columns, F.concat_ws(":", "node", "part").alias("shard"),
        ((F.col("depth") > 0) & (F.col("up_node") == F.col("node")) & (F.col("depth") % sharding.levels > 0)).alias("inside"))
    return _totals(again.withColumn("inside", F.coalesce("inside", F.lit(False))), ["shard"], sharding)
