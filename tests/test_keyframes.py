"""Timed selections against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import filters, keyframes


@pytest.mark.parametrize("tile_rows", [1, 40, 100_000])
@pytest.mark.parametrize("tile", [None, 50, 101, 1000])
def test_motion_gate_equals_brute_force(spark, tile, tile_rows):
    rng = np.random.default_rng(3)
    rows = [(c, int(t), float(m)) for c in "ab" for t, m in
            zip(rng.integers(-500, 1500, 120), rng.integers(0, 30, 120), strict=True)]
    df = spark.createDataFrame(rows, "clip string, t long, m double").withColumn("id", F.monotonically_increasing_id())
    got = keyframes.motion_gate(df, "clip", "t", "m", 100, tile_us=tile, tile_rows=tile_rows).collect()
    want = []
    for i, (c, t, m) in enumerate(rows):
        near = [x for d, u, x in rows if d == c and abs(u - t) <= 50]
        limit = np.percentile(near, 80)
        if m >= limit - 1e-12:
            want.append((c, t, m, round(float(limit), 6)))
    assert sorted((r["clip"], r["t"], r["m"], round(r["threshold"], 6)) for r in got) == sorted(want)


def test_top_confident_and_weights(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([0.69, 0.7, 0.9, 0.9, 0.8])],
                               "clip string, i int, c double")
    kept = keyframes.top_confident(df, "clip", "c", "i", k=3)
    w = {r["i"]: r["alpha"] for r in keyframes.temperature_weights(kept, "clip", "c").collect()}
    e = np.exp(5 * np.array([0.9, 0.9, 0.8]))
    assert np.allclose([w[2], w[3], w[4]], e / e.sum())


def test_align(spark):
    frames = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2)], "clip string, f int")
    audio = spark.range(10).select(F.lit("a").alias("clip"), F.col("id").alias("s"), (F.col("id") * 10).alias("x"))
    got = {r["f"]: r["x"] for r in keyframes.align(frames, audio, "clip", "f", "s", 30.0, 100.0).collect()}
    assert got == {0: 0, 1: 30, 2: 70}


def test_check_pairs(spark):
    clips = spark.createDataFrame([
        ("v", "s1", "ANG", [1.0, 0.0], [1.0, 0.0], 2.0), ("ok", "s2", "SAD", [0.0, 1.0], [0.1, 1.0], 2.1),
        ("long", "s2", "SAD", [0.0, 1.0], [0.1, 1.0], 2.3), ("same", "s1", "SAD", [0.0, 1.0], [0.1, 1.0], 2.0),
        ("emo", "s2", "ANG", [0.0, 1.0], [0.1, 1.0], 2.0), ("close", "s2", "SAD", [1.0, 0.1], [1.0, 0.0], 2.0)],
        "clip_id string, speaker string, emotion string, voice array<double>, reference array<double>, duration double")
    pairs = spark.createDataFrame([("v", a) for a in ("ok", "long", "same", "emo", "close", "gone")],
                                  "video_id string, audio_id string")
    got = {r["audio_id"]: r["ok"] for r in keyframes.check_pairs(pairs, clips).collect()}
    assert got == {"ok": True, "long": False, "same": False, "emo": False, "close": False, "gone": False}


def test_detection_ratio(spark):
    df = spark.createDataFrame([("a", i < 1) for i in range(10)] + [("b", i < 2) for i in range(10)],
                               "k string, failed boolean")
    assert {r["k"]: r["ok"] for r in filters.sufficient_detection(df, "k", "failed").collect()} == {
        "a": True, "b": False}
