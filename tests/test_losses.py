"""No row is lost or added in silence: missing files, odd classes, repeated ids, NaN, NULL."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.functions.scores import verdict
from plumbline.operators import balance, binary, classify, order, scoring
from plumbline.operators.arrays import pad_to_max
from plumbline.sources import manifests


def test_absent_path_keeps_the_others(spark, tmp_path):
    (tmp_path / "a.csv").write_text("file_id\n1\n2\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "none.csv")]
    assert manifests.scan_manifest(spark, paths, ["file_id"]).count() == 2
    assert manifests.scan_manifest(spark, paths[1:], ["file_id"]).count() == 0


def test_classes_out_of_range_are_refused_or_counted(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (5, 5), (5, 0), (None, 1)], "y int, p int")
    row = classify.count_outside(df, "y", "p", 2).first()
    assert (row["n_outside"], row["n"]) == (3, 5)
    with pytest.raises(Exception, match="no class of 0 to 1"):
        classify.f1_scores(df, "y", "p", 2).collect()
    inside = df.filter("y BETWEEN 0 AND 1 AND p BETWEEN 0 AND 1")
    assert classify.f1_scores(inside, "y", "p", 2).first()["n"] == 2


@pytest.mark.parametrize("n", [0, 1, 5, 250, 999, 1000, 2000])
def test_cap_is_exact_with_repeated_ids(spark, n):
    df = spark.range(1000).select((F.col("id") % 10).alias("id"))
    assert order.cap_seeded(df, n, ["id"], 1).count() == min(n, 1000)


def test_quotas_are_exact_with_repeated_ids(spark):
    kinds = F.when(F.col("id") < 100, "g").when(F.col("id") < 120, "p1").otherwise("p2")
    df = spark.range(170).select((F.col("id") % 7).alias("id"), kinds.alias("kind"))
    got = Counter(r["kind"] for r in balance.balance(df, "kind", ["id"], "g", ["p1", "p2"]).collect())
    assert got == {"g": 40, "p1": 20, "p2": 20}


def test_keys_of_several_ids_are_distinct(spark):
    df = spark.createDataFrame([("a", "b:c"), ("a:b", "c"), (None, "c"), ("~", "c"), ("c", None)], "x string, y string")
    assert df.select(order.order_key(["x", "y"], 1).alias("k")).distinct().count() == 5


def test_nan_does_not_reach_a_threshold(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 0.5)], "y int, p double")
    assert [r[0] for r in df.select(verdict("p")).collect()] == ["GENUINE", "FAKE"]
    row = binary.binary_metrics(df, "y", "p").first()
    assert (row["tp"], row["fn"]) == (1, 1)


def test_losses_count_the_rows_they_average(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 0.0), (5, [0.0, 0.0], None)], "y int, s array<double>, x double")
    assert classify.cross_entropy(df, "y", "s").first()["n"] == 1
    assert binary.log_loss(df, "y", "x").first()["n"] == 1


def test_padding_does_not_cut(spark):
    df = spark.createDataFrame([(1, [1.0] * 300), (1, [2.0])], "b int, v array<double>")
    rows = pad_to_max(df, "v", "b").select("padded.*").collect()
    assert sorted((len(r["values"]), r["length"]) for r in rows) == [(300, 1), (300, 300)]


def test_two_loaders_under_one_name(spark):
    import pandas as pd
    df = spark.range(3)

    def loader(value):
        return lambda: lambda b: pd.DataFrame({"id": b["id"], "p": value})

    for value in (0.25, 0.75):
        out = scoring.score(df, "m", loader(value), "id long, p double", ["id"])
        assert {r["p"] for r in out.collect()} == {value}


def test_routing_and_reports_do_not_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("kept", 1)], "route string, x int")
    for write in (lambda p: manifests.write_routed(df, "route", p), lambda p: manifests.write_report(df, p)):
        target = str(tmp_path / f"out{id(write)}")
        write(target)
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
            write(target)


def test_listing_covers_all_registered_sources(spark, tmp_path):
    from plumbline.sources import assets
    registered = []
    for name in ("one", "two"):
        folder = tmp_path / name / "audio"
        folder.mkdir(parents=True)
        (folder / f"{name}_melspec.npy").write_bytes(b"x")
        registered.append(manifests.ManifestSource(name, f"file://{tmp_path}/{name}", "m.csv"))
    rows = assets.list_registry_assets(spark, registered).collect()
    assert {(r["source"], r["file_id"]) for r in rows} == {("one", "one"), ("two", "two")}


def test_refused_rows_have_a_sink(spark, tmp_path):
    from plumbline.streaming import intake
    df = spark.createDataFrame([(1, "a.mp4", 1), (2, "b.txt", 1)], "id long, path string, length long")
    df.write.parquet(str(tmp_path / "in"))
    stream = intake.read_scores(spark, str(tmp_path / "in"), df.schema)
    intake.refused_stream(stream, str(tmp_path / "no"), str(tmp_path / "state"), ["id"]).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "no")).collect()] == [(2, "unsupported format")]
