"""Samples from files: which files are opened, what becomes of broken ones, draws."""

import io
import json
import os

import numpy as np
import pytest

from plumbline.catalog.samples import manifest_rows, write_corpus
from plumbline.plans.samples import prepare_samples
from plumbline.sources.assets import list_registry_assets
from plumbline.sources.files import fetch, read_file, write_files
from plumbline.sources.manifests import ManifestSource

SF = "/root/testdata/sf0.001"


def npy(a):
    buf = io.BytesIO()
    np.save(buf, a)
    return buf.getvalue()


@pytest.fixture
def corpus(tmp_path):
    rng = np.random.default_rng(0)
    mels = {}
    for i, steps in enumerate((5, 12, 3)):
        base, name = tmp_path / "train", f"clip{i}"
        for d in ("audio", "text", f"visual/{name}"):
            (base / d).mkdir(parents=True, exist_ok=True)
        mels[name] = rng.normal(size=(4, steps)).astype(np.float32)
        (base / f"audio/{name}_melspec.npy").write_bytes(npy(mels[name]))
        (base / f"text/{name}_input_ids.npy").write_bytes(npy(np.array([[2 ** 40 + i, 7]])))
        (base / f"text/{name}_attention_mask.npy").write_bytes(npy(np.array([[1, 0]])))
        for f in range(3):
            (base / f"visual/{name}/frame_{f}.jpg").write_bytes(b"x")
    (tmp_path / "train/visual/clip1/attention_weights.json").write_text(
        json.dumps({"frame_1.jpg": {"alpha": 0.7}, "frame_0.jpg": {}}))
    (tmp_path / "train/visual/clip2/keyframe_weights.npy").write_bytes(npy(np.array([0.5, 0.25, 0.25])))
    return tmp_path, mels


def prepared(spark, root, **kw):
    source = ManifestSource("c", str(root), "m.csv", subdirs=("train",))
    manifest = spark.createDataFrame([("c", f"clip{i}", "x") for i in range(4)], "source string, file_id string, audio string")
    return {r.file_id: r for r in prepare_samples(manifest, list_registry_assets(spark, [source]), 6, 2, **kw).collect()}


def test_arrays_and_weights(spark, corpus):
    root, mels = corpus
    rows = prepared(spark, root)
    assert set(rows) == {"clip0", "clip1", "clip2"} and all(r.error is None for r in rows.values())
    for name, m in mels.items():
        z = (m.astype(float) - m.mean(dtype=float)) / (m.std(dtype=float) + 1e-6)
        start = max(0, (z.shape[1] - 6) // 2)
        want = np.zeros((4, 6))
        part = z[:, start:start + 6]
        want[:, :part.shape[1]] = part
        assert np.allclose(rows[name].mel, want, atol=1e-6)
    assert rows["clip1"].input_ids == [2 ** 40 + 1, 7] and rows["clip1"].attention_mask == [1, 0]
    assert (rows["clip1"].frames, rows["clip1"].alpha) == (["frame_0.jpg", "frame_1.jpg"], [0.0, 0.7])
    assert (rows["clip2"].frames, rows["clip2"].alpha) == (["frame_0.jpg", "frame_1.jpg"], [0.5, 0.25])
    assert rows["clip0"].alpha == [1 / 3, 1 / 3]
    assert prepared(spark, root, equal_weights=True)["clip2"].alpha == [1.0, 1.0]


def test_drawn_crops_repeat(spark, corpus):
    root, _ = corpus
    one, two = prepared(spark, root, augment_seed=3), prepared(spark, root, augment_seed=3)
    assert {k: r.mel for k, r in one.items()} == {k: r.mel for k, r in two.items()}
    assert any(prepared(spark, root, augment_seed=s)["clip1"].mel != one["clip1"].mel for s in range(4, 8))


def test_broken_files_are_values(spark, corpus):
    root, _ = corpus
    (root / "train/audio/clip0_melspec.npy").write_bytes(b"junk")
    (root / "train/visual/clip2/keyframe_weights.npy").write_bytes(b"junk")
    rows = prepared(spark, root)
    assert rows["clip0"].mel is None and rows["clip0"].error and rows["clip0"].input_ids
    assert rows["clip2"].error and rows["clip2"].alpha == [1 / 3, 1 / 3] and rows["clip2"].mel
    assert rows["clip1"].error is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_only_chosen_files_are_opened(spark, tmp_path):
    source = write_corpus(spark, SF)
    marks = str(tmp_path)

    def opener(path):
        import hashlib
        import uuid
        with open(f"{marks}/{hashlib.md5(path.encode()).hexdigest()}-{uuid.uuid4().hex}", "w") as f:
            f.write(path)
        return read_file(path)

    listing = list_registry_assets(spark, [source])
    out = prepare_samples(manifest_rows(spark, source), listing, width=4, opener=opener)
    rows = out.select("file_id", "error").collect()
    assert not [r for r in rows if r.error]
    opened = [open(os.path.join(marks, f)).read() for f in os.listdir(marks)]
    labels = dict(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label").collect())
    # Audio, ids, mask, and weights where there are any; each file once.
    assert len(opened) == len(set(opened)) == sum(3 + (labels[int(r.file_id)] < 6) for r in rows)
    assert not [p for p in opened if read_file(p) == b"broken"]
    assert len(rows) == sum(i % 11 != 10 for i in labels)
    assert listing.count() > 2 * len(opened)


def test_fetch_and_write(spark, tmp_path):
    rows = [(1, f"{tmp_path}/a/b/one", b"1"), (2, f"file:{tmp_path}/a/two", b""), (3, None, b"3"), (4, f"{tmp_path}/x", None)]
    df = spark.createDataFrame(rows, "id int, path string, content binary")
    assert write_files(df, "path", "content") == 2 == write_files(df, "path", "content")
    got = {r.id: (r.raw and bytes(r.raw), r.error) for r in fetch(df, {"path": "raw"}).collect()}
    assert got == {1: (b"1", None), 2: (b"", None), 3: (None, None), 4: (None, "FileNotFoundError")}
    assert fetch(df.limit(0), {"path": "raw"}).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_few_tasks_for_many_files(spark):
    source = write_corpus(spark, SF)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few-tasks", "")
    try:
        listing = list_registry_assets(spark, [source])
        n = prepare_samples(manifest_rows(spark, source), listing, width=4).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s)))
    # A task for some tens of files would be more than that, as there are thousands.
    assert n > 400 and listing.count() > 4000 and tasks < 150
