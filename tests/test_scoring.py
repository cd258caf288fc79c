"""Model scoring, verdict records, heads and the streaming intake."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.scores import verdict
from plumbline.operators import scoring
from plumbline.streaming import intake


def load():
    return lambda batch: pd.DataFrame({"id": batch["id"], "p": batch["x"].clip(0, 1)})


def test_score(spark):
    df = spark.range(100).select("id", (F.col("id") / 100).alias("x"), F.lit("unused").alias("text"))
    out = scoring.score(df, "clip", load, "id long, p double", ["id", "x"])
    assert {r["id"]: r["p"] for r in out.collect()} == {i: i / 100 for i in range(100)}


def test_verdict_record(spark):
    df = spark.sql("""SELECT 0D AS logit, array(0D,0D,0D,0D,0D,2D) AS a, array(3D,0D,0D,0D,0D,0D) AS v,
                      array(1D,2D) AS za, array(1D,5D) AS zv, ' ' AS t""")
    r = scoring.verdict_record(df, "logit", "a", "v", "za", "zv", "t").first()
    assert (r["fake_prob"], r["verdict"], r["transcript"], r["discrepancy_l2"]) == (0.5, "FAKE", "[inaudible]", 3.0)
    a = [math.exp(x) for x in (0, 0, 0, 0, 0, 2)]
    assert r["audio_emotion"]["Sad"] == round(a[5] / sum(a), 4)
    m = r["dominant_mismatch"]
    assert (m["emotion"], m["audio_dominant"], m["visual_dominant"]) == ("Angry", "Sad", "Angry")
    assert m["delta"] == r["per_class_delta"]["Angry"] == max(r["per_class_delta"].values())


@pytest.mark.parametrize("layers", [(), (4,)])
def test_fit_head_separates(spark, layers):
    df = spark.range(80).select(
        "id", (F.col("id") % 2).cast("int").alias("y"), F.array(F.lit(1.0), F.col("id") % 5 * 0.1).alias("a"),
        F.array(F.col("id") % 2 * 2.0, F.lit(0.5)).alias("b"))
    model = scoring.fit_head(df, "a", "b", "y", layers, max_iter=30)
    out = scoring.score_head(model, df, "a", "b")
    assert out.columns == ["id", "y", "a", "b", "p"]
    assert all((r["p"] >= 0.5) == (r["y"] == 1) for r in out.collect())


def test_intake_stream(spark, tmp_path):
    src, sink, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    rows = [(i, "c.mp4" if i % 2 else "c.txt", 10, i / 20) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, path string, length long, x double")
    df.repartition(4).write.parquet(src)

    def judge(d):
        scored = scoring.score(d, "clip", load, "id long, p double", ["id", "x"])
        return scored.withColumn("verdict", verdict("p"))

    def run():
        stream = intake.read_scores(spark, src, df.schema, per_trigger=1)
        intake.intake_stream(stream, judge, sink, state).awaitTermination()
        return {r["id"]: r["verdict"] for r in spark.read.parquet(sink).collect()}

    first = run()
    assert first == {i: "FAKE" if i >= 10 else "GENUINE" for i in range(1, 20, 2)}
    df.selectExpr("id + 101 AS id", "'n.mp4' AS path", "length", "x").limit(3).write.mode("append").parquet(src)
    assert len(run()) == len(first) + 3
    assert spark.read.parquet(sink).count() == len(first) + 3


def test_file_intake_refuses(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x" * 10)
    (tmp_path / "b.txt").write_bytes(b"x")
    ok, refused = intake.admitted(intake.read_files(spark, str(tmp_path)))
    q = ok.select("path", "length").writeStream.format("memory").queryName("taken").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["length"] for r in spark.table("taken").collect()] == [10]
    assert refused.isStreaming
