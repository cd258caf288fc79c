"""Splits, balance, ranks: exact sizes and membership against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.operators import balance as B
from plumbline.operators import order as O
from plumbline.operators import sampling, splits
from plumbline.session import join_summary


def okey(value, seed=42):
    return hashlib.md5(f"{value}:{seed}".encode()).hexdigest(), str(value)


def by_rank(values, first, second):
    out = {}
    for i, v in enumerate(sorted(values, key=okey)):
        out[v] = "train" if i < first else "val" if i < first + second else "test"
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 5, 10, 25, 91])
def test_group_partition_sizes(spark, n):
    df = spark.range(n * 3).select((F.col("id") % max(n, 1)).alias("g"))
    got = {r["g"]: r["part"] for r in splits.group_partition(df, "g").collect()}
    assert got == by_rank(range(n), round(n * 0.8), round(n * 0.1))
    rows = splits.split_by_group(df, "g").collect()
    assert len(rows) == n * 3 and all(got[r["g"]] == r["part"] for r in rows)


def test_stratified_split_is_exact_per_stratum(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 707, "b")
                                  .otherwise("c").alias("s"))
    df = df.unionByName(spark.sql("SELECT 5000L AS id, CAST(NULL AS STRING) AS s"))
    got = splits.stratified_split(df, ["s"], ["id"]).collect()
    strata = defaultdict(list)
    for r in df.collect():
        strata[r["s"]].append(r["id"])
    want = {}
    for ids in strata.values():
        want.update(by_rank(ids, int(len(ids) * 0.8), int(len(ids) * 0.1)))
    assert {r["id"]: r["part"] for r in got} == want


@pytest.mark.parametrize("digits", [1, 4])
def test_cut_points_do_not_depend_on_bucket_width(spark, digits):
    units = spark.range(500).select(O.order_key(["id"], 7).alias("k"))
    cuts = O.cut_points(units, [], "k", None, lambda n: [F.lit(1), F.floor(n / 3), n, F.lit(0)],
                        digits=digits).frame.first()
    keys = sorted(r["k"] for r in units.collect())
    assert list(cuts) == [keys[0], keys[500 // 3 - 1], keys[-1], None]


def test_group_aware_split_with_a_giant_group(spark):
    rows = [("giant", i) for i in range(60)] + [(f"g{i % 20}", 100 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i int")
    got = {r["g"]: r["part"] for r in splits.group_aware_split(df, "g").collect()}
    sizes = Counter(g for g, _ in rows)
    count, want = 0, {}
    for g in sorted(sizes, key=okey):
        want[g] = "train" if count < 96 else "val" if count < 108 else "test"
        count += sizes[g]
    assert got == want


def test_stored_partition_covers_a_later_subset(spark):
    df = spark.range(91).select(F.col("id").alias("g"))
    parts = splits.group_partition(df, "g")
    subset = df.filter("g <> 17")
    a = {r["g"]: r["part"] for r in splits.apply_partition(subset, parts, "g").collect()}
    full = {r["g"]: r["part"] for r in parts.collect()}
    assert a == {g: p for g, p in full.items() if g != 17}


def test_folds(spark):
    folds = splits.fold_of(spark.range(103), ["id"], 10).collect()
    sizes = Counter(r["fold"] for r in folds)
    assert sorted(sizes) == list(range(10)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert len(folds) == 103


@pytest.mark.parametrize("g, p1, p2", [(30, 10, 20), (10, 10, 20), (5, 7, 7), (5, 0, 7), (0, 3, 3)])
def test_balance(spark, g, p1, p2):
    kinds = ["g"] * g + ["p1"] * p1 + ["p2"] * p2 + ["other"] * 4
    df = spark.createDataFrame(list(enumerate(kinds)), "id int, kind string")
    got = Counter(r["kind"] for r in B.balance(df, "kind", ["id"], "g", ["p1", "p2"]).collect())
    m = min(p1, p2)
    n = min(g, 2 * m)
    assert got["g"] == n and got["p1"] + got["p2"] == n and got["other"] == 0
    if g >= 2 * m:
        assert got["p1"] == got["p2"] == m


def test_ranked_spread_equals_window(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") * 7919 % 101).alias("v"))
    plain = O.ranked(df, ["g"], [F.desc("v"), "id"])
    spread = O.ranked(df, ["g"], [F.desc("v"), "id"], group_rows=100)
    assert sorted(plain.collect()) == sorted(spread.collect())
    assert sorted(O.ranked(df, [], ["v", "id"], group_rows=100).select("rank").collect()) == [
        (i,) for i in range(1, 3001)]


def test_join_summary_salted_path_with_hot_and_null_keys(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") < 200, "hot").when(F.col("id") < 250, "b")
                                   .alias("k"))
    facts = spark.createDataFrame([("hot", 1), ("b", 2), (None, 3)], "k string, v int")
    small = join_summary(rows, facts, ["k"], small=True)
    large = join_summary(rows, facts, ["k"], small=False)
    want = sorted((r["id"], r["v"]) for r in small.collect())
    assert want == sorted((r["id"], r["v"]) for r in large.collect())
    assert Counter(v for _, v in want) == {1: 200, 2: 50, 3: 50}


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 30, 100])
@pytest.mark.parametrize("k", [1, 8])
def test_uniform_k(spark, n, k):
    df = spark.range(n).select(F.lit("c").alias("c"), "id")
    got = sampling.uniform_k(df, "c", ["id"], k).orderBy("slot").collect()
    want = [0] if k == 1 else [i * (n - 1) // (k - 1) for i in range(k)]
    assert [r["id"] for r in got] == want and [r["slot"] for r in got] == list(range(k))
    if n == 100:
        spread = sampling.uniform_k(df, "c", ["id"], k, group_rows=9).orderBy("slot").collect()
        assert spread == got


def test_first_k_cap_top(spark):
    df = spark.range(40).select((F.col("id") % 3).alias("g"), "id")
    assert sampling.first_k(df, "g", ["id"], 2).count() == 6
    assert [r["id"] for r in O.cap(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert [tuple(r) for r in sampling.top_values(df, "g", 2).collect()] == [(0, 14), (1, 13)]


def test_keys_may_be_columns(spark):
    df = spark.range(60).select("id", F.concat(F.col("id") % 12, F.lit("_x")).alias("fid"))
    by_name = splits.split_by_group(df.withColumn("g", F.split("fid", "_")[0]), "g")
    by_col = splits.split_by_group(df, F.split("fid", "_")[0])
    assert by_col.columns == ["id", "fid", "part"]
    assert sorted((r["id"], r["part"]) for r in by_name.collect()) == sorted(
        (r["id"], r["part"]) for r in by_col.collect())
    strat = splits.stratified_split(df, [F.col("id") % 3], ["id"]).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in strat} == {"train": 48, "val": 6, "test": 6}
