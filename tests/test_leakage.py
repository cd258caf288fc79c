"""Overlap checks and the audit report."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import health, leakage
from plumbline.plans import curation


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def test_overlap_counts_distinct_keys(spark):
    r = leakage.overlap(ids(spark, "a", "a", "b", None), ids(spark, "b", "c", "d"), "k").first()
    assert tuple(r) == (2, 3, 1)
    empty = leakage.overlap(ids(spark, "a").limit(0), ids(spark, "b"), "k").first()
    assert tuple(empty) == (0, 1, 0)


@pytest.mark.parametrize("a, b, equal, disjoint", [
    ("ab", "ba", True, False), ("ab", "b", False, False), ("ab", "c", False, True)])
def test_same_set(spark, a, b, equal, disjoint):
    assert tuple(leakage.same_set(ids(spark, *a), ids(spark, *b), "k").first()) == (equal, disjoint)


def test_missing(spark):
    assert [r["k"] for r in leakage.missing(ids(spark, "a", "a", "b"), ids(spark, "b"), "k").collect()] == ["a"]


def test_disjointness(spark):
    df = spark.createDataFrame([("g1", "train"), ("g1", "test"), ("g2", "val"), ("g3", "test"), ("g3", "val"),
                                ("g4", None)], "g string, part string")
    got = {(r["part_a"], r["part_b"]): r["n_shared"] for r in leakage.disjoint_check(df, "g").collect()}
    assert got == {("train", "val"): 0, ("train", "test"): 1, ("val", "test"): 1}
    with pytest.raises(ValueError, match="2 keys"):
        leakage.assert_disjoint(df, "g")
    leakage.assert_disjoint(df.filter("part = 'test'"), "g")


def test_part_sizes_and_gates(spark):
    df = spark.createDataFrame([("train",), ("train",), ("val",)], "part string")
    assert {r["part"]: r["n"] for r in leakage.part_sizes(df).collect()} == {"train": 2, "val": 1, "test": 0}
    with pytest.raises(ValueError, match="test"):
        leakage.assert_nonempty(df)
    health.assert_constant(df, F.lit(3))
    with pytest.raises(ValueError, match="not constant"):
        health.assert_constant(df, "part")


def test_class_profile_cap(spark):
    df = spark.range(10).select(F.lit("c").alias("c"), F.col("id").alias("v"))
    full = health.class_profile(df, "c", "v").first()
    assert (full["n"], full["mean"], full["min"], full["max"]) == (10, 4.5, 0, 9)
    capped = health.class_profile(df, "c", F.col("v") * 2, cap=3, order=["v"]).first()
    assert (capped["n"], capped["mean"], capped["max"]) == (3, 2, 4)


def test_audit_flags_a_leak(spark):
    rows = [("1_a", "1", "1", 0, "train", 10, [0.5, 0.5]), ("1_b", "1", "1", 1, "test", 20, [0.9, 0.1]),
            ("2_a", "2", "2", 0, "test", 30, [0.5, 0.5]), ("3_a___9_b", "3", "9", 1, "test", 40, [1.0, 0.0]),
            ("4_a", "4", "4", 0, "val", 50, [0.0, 0.0])]
    pairs = spark.createDataFrame(rows, "file_id string, group_key string, donor_key string, label int, "
                                        "part string, n int, w array<double>")
    first = spark.createDataFrame([("2_a", "2", "train"), ("9_x", "9", "train"), ("3_z", "3", "val")],
                                  "file_id string, group_key string, part string")
    got = {(r["check"], r["subject"]): (r["value"], r["ok"]) for r in
           curation.audit(pairs, first, "n", "w").collect()}
    assert got[("parts_share_groups", "train-test")] == (1, False)
    assert got[("parts_share_groups", "train-val")] == (0, True)
    assert got[("heldout_seen_in_first_stage", "clips")] == (1, False)
    assert got[("heldout_seen_in_first_stage", "groups")] == (1, False)
    assert got[("heldout_donors_seen", "donor groups")] == (1, True)
    assert got[("weight_std", "Genuine Pairs")] == (0, True)          # the all-zero row is left out
    assert got[("weight_std", "Cross-Identity Spliced")] == (0.5, True)
    assert got[("test_mix", "Emotion Tampering")] == (1, True)
    assert got[("part_rows", "test")] == (3, True)
