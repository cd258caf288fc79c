"""The prefix trie against one built in plain Python, and the spilling queue by itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from plumbline.llm import trie
from plumbline.llm.trie import Sharding, SpillingQueue

TINY = Sharding(turns=3, share=0, levels=2, block=3, salts=2, queue=2, ids=2)
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = defaultdict(int)
    for seq in members:
        if seq:
            kids[seq[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for seq, who in members.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += not kids[seq]
            saved[seq[:d]] += (len(who) - 1) * len(seq[-1][1]) if seq else 0
    return sorted((who[0], len(seq), members[seq[:-1]][0] if seq else -1, len(who), kids[seq], leaves[seq], saved[seq],
                   hashlib.sha256(",".join(str(c) for c in who if len(convs[c]) == len(seq)).encode()).hexdigest())
                  for seq, who in members.items())


def spark_nodes(spark, rows, sharding):
    df = spark.createDataFrame(rows, SCHEMA)
    got = trie.prefix_trie(*trie.share_heads(df), sharding)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in got.collect())


def drawn(seed, convs=70, most=9):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-120, 420), convs):
        for t in range(draw.randrange(1, most)):
            rows.append((c, t, draw.choice(["user", "bot", None]), draw.choice(["a", "bc", "déf", "", None])))
    return rows


@pytest.mark.parametrize("sharding", [TINY, Sharding()])
def test_random_conversations(spark, sharding):
    rows = drawn(1)
    assert spark_nodes(spark, rows, sharding) == brute(rebuilt(rows))


def test_long_chains_copies_and_growing_snapshots(spark):
    # One conversation far longer than the rest, snapshots of it at every turn, copies of them.
    turns = [("user", f"t{i % 7}") for i in range(60)]
    rows = [(1000, t, *turns[t]) for t in range(60)]
    for c in range(1001, 1030):
        rows += [(c, t, *turns[t]) for t in range(2 * (c - 1000))]
    rows += [(c, t, *turns[t]) for c in range(1100, 1110) for t in range(6)]
    rows += [(c, 0, "user", f"only {c}") for c in range(2000, 2040)]
    assert spark_nodes(spark, rows, TINY) == brute(rebuilt(rows))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, None, None, None), (5, 2, "user", "b"), (5, 2, "user", "a"),
            (5, 2, "user", "a"), (7, 1, "user", "x" * 50_000), (100, 1, "user", "q"), (101, 1, "user", "q"),
            (101, 2, "bot", ""), (999, 3, "", "")]
    assert spark_nodes(spark, rows, TINY) == brute(rebuilt(rows))
    assert spark_nodes(spark, [], TINY) == []


def test_clashing_columns(spark):
    rows = drawn(3, convs=10)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", place string, depth int")
    got = trie.prefix_trie(*trie.share_heads(df))
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got.collect()) == brute(rebuilt(rows))


def test_queue_spills_and_keeps_order():
    draw = random.Random(4)
    queue, held, out = SpillingQueue(5, fan=3), [], []
    for _ in range(3000):
        if held and draw.random() < 0.4:
            assert queue.least() == min(held)
            out.append(queue.pop())
            held.remove(out[-1])
        else:
            message = ((draw.randrange(-50, 0), draw.randrange(100)), draw.randrange(9), draw.randrange(9))
            queue.push(message)
            held.append(message)
    assert queue.made > 100 and len(queue.heap) <= 6
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.least() is None
