"""Batches of bounded padded size."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import batches


def test_budget_holds_and_every_row_is_in_once(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice([0, 1, 7, 8, 9, 30, 31, 32, 33, 500])) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "id long, n int")
    out = batches.length_batches(df, "n", ["id"], budget=100, max_length=64).collect()
    assert sorted((r.id, r.n) for r in out) == rows
    by = {}
    for r in out:
        by.setdefault(r.batch, []).append(min(r.n or 0, 64))
    assert sorted(by) == list(range(len(by)))
    assert all(len(v) * max(v) <= 100 for v in by.values())
    # Only the last batch of a rounded length may have room for another of its rows.
    last = {}
    for b in sorted(by):
        last[-(-max(max(by[b]), 1) // 8)] = b
    for b, v in by.items():
        wide = -(-max(max(v), 1) // 8) * 8
        assert len(v) == 100 // wide or last[wide // 8] == b
    report = batches.batch_report(batches.length_batches(df, "n", ["id"], 100, 64), "n", 64).first()
    assert (report.n_rows, report.n_batches, report.largest) == (301, len(by), max(len(v) * max(v) for v in by.values()))
    assert report.padding == pytest.approx(1 - sum(map(sum, by.values())) / sum(len(v) * max(v) for v in by.values()))


def test_collate_pads_to_the_longest(spark):
    df = spark.createDataFrame([(i, [float(i)] * (i % 5)) for i in range(20)] + [(20, None)], "id long, v array<double>")
    out = batches.collate(batches.length_batches(df, F.size("v"), ["id"], 32, 8), "v", ["id"], 8).collect()
    seen = {}
    for r in out:
        assert len(r["items"]) <= 4
        for i in r["items"]:
            assert len(i["values"]) == r["width"]
            seen[i["id"]] = i["values"][:i["length"]]
    assert seen == {i: [float(i)] * (i % 5) for i in range(20)} | {20: []}


def test_refuses_rows_beyond_the_budget(spark):
    with pytest.raises(ValueError, match="does not fit"):
        batches.length_batches(spark.range(1), "id", ["id"], budget=8, max_length=9)
    assert batches.length_batches(spark.range(0), "id", ["id"], 16, 8).count() == 0
    assert batches.batch_report(batches.length_batches(spark.range(0), "id", ["id"], 16, 8), "id").first().n_rows == 0
