"""Reports that take one pass: health with observed totals, audit by masks, routed intake."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.catalog import QUERIES
from plumbline.catalog.curate import checked_files
from plumbline.catalog.samples import report_on, write_faulty
from plumbline.functions.scores import verdict
from plumbline.operators import leakage, scoring
from plumbline.plans import curation
from plumbline.sources import assets
from plumbline.sources.manifests import ManifestSource
from plumbline.streaming import intake

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def jobs_of(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"g{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(tracker.getJobIdsForGroup(group))


@tables
def test_health_gate_runs_no_job(spark):
    report = report_on(spark, write_faulty(spark, SF))
    rows = {(r.source, r.name): r.n for r in report.rows.filter("section = 'total'").collect()}
    assert rows == report.totals and report.problems() > 0

    def gate():
        with pytest.raises(ValueError, match=f"{report.problems()} integrity"):
            report.require_healthy()
    assert jobs_of(spark, gate)[1] == 0


def test_health_of_nothing(spark, tmp_path):
    manifest = spark.createDataFrame([("s", "a"), ("s", "b")], "source string, file_id string")
    listing = spark.createDataFrame([], "source string, base string, base_rank int, file_id string, kind string, "
                                        "variant int, path string, length long, content binary")
    report = curation.health_report(manifest, listing, ["s", "t"], str(tmp_path / "out"))
    assert report.totals == {("s", "full"): 0, ("s", "partial"): 0, ("s", "absent"): 2, ("s", "problems"): 0,
                             ("t", "full"): 0, ("t", "partial"): 0, ("t", "absent"): 0, ("t", "problems"): 0}
    report.require_healthy()
    assert report.rows.filter("section <> 'total'").count() == 0


def test_masks_tell_sets_apart(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), ("c", 2), ("d", 3)], "k string, s int")
    m = leakage.marks("x", "k", {1: F.col("s") == 1, 2: F.col("s") == 2})
    counts = leakage.mask_counts([df.select(F.array(m).alias("marks"))])
    assert {(r.space, r.mask): r.n for r in counts.collect()} == {("x", 3): 1, ("x", 1): 1, ("x", 2): 1}
    row = counts.agg(leakage.in_all("x", 1, 2).alias("both"), leakage.in_all("x", 1).alias("one"),
                     leakage.in_all("y", 1).alias("none")).first()
    assert tuple(row) == (1, 2, 0)


@tables
def test_audit_reads_little(spark):
    pairs = spark.createDataFrame([("1_a", "1", "1", 0, "train", 3, [1.0])] * 4, "file_id string, group_key string, "
                                  "donor_key string, label int, part string, n int, w array<double>")
    df, jobs = jobs_of(spark, lambda: curation.audit(pairs, pairs.select("file_id", "group_key", "part"), "n", "w"))
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert jobs <= 2 and plan.count("Exchange") <= 6
    assert plan.count("FileScan") + plan.count("Scan ExistingRDD") <= 4
    plan = QUERIES["audit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("bit_or") >= 2 and "Expand" in plan


def load():
    return lambda batch: pd.DataFrame({"id": batch["id"], "p": batch["x"].clip(0, 1)})


def test_routing_survives_a_stop_between_the_writes(spark, tmp_path):
    src, target, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    rows = [(i, "c.mp4" if i % 3 else "c.txt", 10, i / 40) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, path string, length long, x double")
    df.repartition(4).write.parquet(src)
    calls = []

    def judge(d):
        return scoring.score(d, "route", load, "id long, p double", ["id", "x"]).withColumn("verdict", verdict("p"))

    def run(between=None):
        stream = intake.read_scores(spark, src, df.schema, per_trigger=1)
        query = intake.route_stream(stream, judge, target, state, ["id", "path"], between=between)
        query.awaitTermination()
        return query

    def stop(number):
        calls.append(number)
        if number == 2:
            raise RuntimeError("stopped here")

    with pytest.raises(Exception, match="stopped here"):
        run(stop)
    assert calls == [0, 1, 2]
    # Verdicts of the last micro-batch are there, its refusals are not.
    assert len(os.listdir(f"{target}/verdicts")) == 3 and len(os.listdir(f"{target}/refused")) == 2
    query = run(lambda number: calls.append(number))
    assert calls == [0, 1, 2, 2, 3]
    got = intake.routed(spark, target).collect()
    assert sorted(r.id for r in got) == list(range(40))
    assert {r.id for r in got if r.reject_reason} == set(range(0, 40, 3))
    # The source is read once a micro-batch, though both tables come from it.
    assert sum(p["numInputRows"] for p in query.recentProgress) == sum(
        df.filter("true").count() for _ in range(1)) * 2 // 4
    run()
    assert intake.routed(spark, target).count() == 40


@tables
@pytest.mark.parametrize("parts", [1, 3])
def test_intake_reads_a_table_of_files(spark, tmp_path, parts):
    one = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = {r.vec_id: r.label >= 5 for r in one.select("vec_id", "label").collect()}
    if parts == 1:
        os.symlink(f"{SF}/embeddings.parquet", tmp_path / "embeddings.parquet")
    else:
        one.repartition(parts).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["intake_stream"](spark, str(tmp_path)).select("vec_id", "reject_reason").collect()
    assert len(got) == len(want) and {r.vec_id: r.reject_reason is not None for r in got} == want


def test_health_without_contents(spark, tmp_path):
    import numpy as np
    for folder in ("audio", "text", "visual/a", "visual/b"):
        (tmp_path / folder).mkdir(parents=True)
    for name, array in (("audio/a_melspec.npy", np.ones((80, 3))), ("audio/b_melspec.npy", np.full((80, 2), np.nan)),
                        ("text/a_input_ids.npy", np.ones((1, 7), int)), ("text/a_attention_mask.npy", np.ones((1, 5), int)),
                        ("visual/b/keyframe_weights.npy", np.array([np.inf]))):
        np.save(tmp_path / name, array)
    (tmp_path / "visual/a/frame_1.jpg").write_bytes(b"junk")
    (tmp_path / "visual/a/attention_weights.npy").write_bytes(b"junk")
    (tmp_path / "visual/a/notes.npy").write_bytes(b"junk")
    source = ManifestSource("s", str(tmp_path), "m.csv")
    manifest = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "source string, file_id string")

    def report(content):
        listing = assets.list_assets(spark, source, content)
        out = curation.health_report(manifest, listing, ["s"], str(tmp_path / f"out-{content}"))
        return sorted(out.rows.collect(), key=str), sorted(curation.health_check(manifest, listing).collect(), key=str)

    with_contents, without = report(True), report(False)
    assert without == with_contents
    assert {(r.file_id, r.issue) for r in without[1]} == {
        ("a", "shape mismatch (1, 7) vs (1, 5)"), ("a", "load_error:ValueError"), ("b", "NaN"), ("b", "no frames"), ("b", "Inf")}


@tables
def test_files_are_made_in_one_pass(spark):
    plan = checked_files(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    assert checked_files(spark, SF).select("path").distinct().count() == checked_files(spark, SF).count() > 2000


@tables
def test_files_are_not_made_while_they_are_probed(spark):
    # A task runs one Python worker for each such step of its plan.
    plan = QUERIES["issues"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
