"""Generated splice pairs against turns played one by one."""

import hashlib

import numpy as np
import pytest

from plumbline.operators import keyframes, pairing

SCHEMA = "clip_id long, speaker string, emotion int, voice array<double>, reference array<double>, duration double"


def place(ident, seed):
    return int(hashlib.md5(f"{ident}:{seed}".encode()).hexdigest()[:10], 16)


def cosine(a, b):
    return float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))


def admissible(v, a, slack=0.2):
    return (v[1] != a[1] and v[2] != a[2] and cosine(a[3], a[4]) >= 0.75 and cosine(a[3], v[4]) <= 0.4
            and abs(v[5] - a[5]) <= slack)


def turns(rows, quota, seed=42):
    used, out = {}, {}
    for v in sorted(rows, key=lambda r: (place(r[0], seed), r[0])):
        home = place(v[0], seed + 1)
        ring = sorted(rows, key=lambda a: (place(a[0], seed + 1) < home, place(a[0], seed + 1), a[0]))
        for a in ring:
            if used.get(a[0], 0) < quota and admissible(v, a):
                out[v[0]] = a[0]
                used[a[0]] = used.get(a[0], 0) + 1
                break
    return out


def drawn(n, seed, durations, speakers=4, emotions=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        voice = rng.normal(size=4)
        rows.append((i * 3, f"s{rng.integers(speakers)}", int(rng.integers(emotions)), voice.tolist(),
                     (voice + 0.6 * rng.normal(size=4)).tolist(), float(rng.choice(durations))))
    return rows


@pytest.mark.parametrize(("quota", "durations", "arc"), [(1, [1.0], 5), (2, [0.0, 0.15, 0.3, 0.45, 2.0], 4), (3, [1.0], 256)])
def test_equals_turns(spark, quota, durations, arc):
    rows = drawn(60, quota, durations)
    clips = spark.createDataFrame(rows, SCHEMA)
    pairs = pairing.match_clips(clips, quota=quota, arc=arc, meet=7)
    got = {r.video_id: r.audio_id for r in pairs.collect()}
    assert got == turns(rows, quota) and got
    assert keyframes.check_pairs(pairs.select("video_id", "audio_id"), clips).filter("NOT ok").count() == 0
    # Nobody is left out who could still have an audio.
    uses = {a: list(got.values()).count(a) for a in got.values()}
    for v in rows:
        if v[0] not in got:
            assert not [a for a in rows if admissible(v, a) and uses.get(a[0], 0) < quota]


def test_fewer_audios_than_videos(spark):
    rows = drawn(50, 9, [1.0], speakers=2, emotions=2)
    # Most clips are unlike their own reference, so they are videos only.
    rows = [r if i % 6 == 0 else (*r[:4], [-x for x in r[3]], r[5]) for i, r in enumerate(rows)]
    got = {r.video_id: r.audio_id for r in pairing.match_clips(spark.createDataFrame(rows, SCHEMA), arc=3).collect()}
    assert got == turns(rows, 1) and len(got) <= 9


def test_odd_clips(spark):
    one = (1, "a", 1, [1.0, 0.0], [1.0, 0.0], 1.0)
    rows = [one, (2, "b", 2, [0.0, 1.0], [0.0, 1.0], 1.1), (3, None, 1, [1.0, 0.0], [1.0, 0.0], 1.0),
            (4, "c", None, [1.0, 0.0], [1.0, 0.0], 1.0), (5, "d", 3, None, None, 1.0), (6, "e", 4, [0.0, 0.0], [0.0, 0.0], 1.0),
            (7, "f", 5, [1.0, 1.0], [1.0, 1.0], None)]
    pairs = {(r.video_id, r.audio_id) for r in pairing.match_clips(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert pairs == {(1, 2), (2, 1)}
    assert pairing.match_clips(spark.createDataFrame([one], SCHEMA)).count() == 0
    assert pairing.match_clips(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_round_runs_few_jobs(spark, monkeypatch):
    rows = drawn(60, 2, [0.0, 0.15, 0.3, 0.45, 2.0])
    clips = spark.createDataFrame(rows, SCHEMA)
    rounds, own = [], pairing._proposals
    monkeypatch.setattr(pairing, "_proposals", lambda *a: (rounds.append(1), own(*a))[1])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few-jobs", "")
    try:
        got = {r.video_id: r.audio_id for r in pairing.match_clips(clips, quota=2, arc=4).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == turns(rows, 2)
    jobs = len(tracker.getJobIdsForGroup("few-jobs")) / len(rounds)
    assert len(rounds) > 3 and jobs < 25, jobs
