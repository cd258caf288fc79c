"""Manifests, asset trees and health on small files, with every edge the readers know."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.keys import SEVEN_CLASSES, label_from_text
from plumbline.operators import filters, health, resolve
from plumbline.plans import curation
from plumbline.sources import arrays, assets, manifests
from plumbline.sources.manifests import ManifestSource

CSV = ('file_id,forgery_type,note\n'
       'a_1_ANG,forged,x\n'            # the first copy of a_1_ANG is not genuine
       'a_1_ANG,genuine,"two\nlines, ""quoted"""\n'
       'b_1_SAD,genuine,\n'
       'c_1_SAD\n'                     # short row
       'd_1_HAP,,empty\n'
       'b_1_SAD,genuine,again\n')


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return tmp_path_factory.mktemp("manifests")


def test_scan_manifest(spark, root):
    path = root / "m.csv"
    path.write_text(CSV, encoding="utf-8")
    df = manifests.scan_manifest(spark, str(path), file_order=True)
    assert set(df.dtypes[:3]) == {(c, "string") for c in ("file_id", "forgery_type", "note")}
    rows = df.orderBy(*manifests.FILE_ORDER).collect()
    assert [r["file_id"] for r in rows] == ["a_1_ANG", "a_1_ANG", "b_1_SAD", "c_1_SAD", "d_1_HAP", "b_1_SAD"]
    assert rows[1]["note"] == 'two\nlines, "quoted"'
    assert rows[3]["forgery_type"] is None and rows[4]["forgery_type"] is None
    gone = manifests.scan_manifest(spark, str(root / "none.csv"), ["file_id"], file_order=True)
    assert gone.count() == 0 and gone.columns == ["file_id", *manifests.FILE_ORDER]


def test_filters_on_empty_cells_and_missing_column(spark, root):
    df = manifests.scan_manifest(spark, str(root / "m.csv"))
    ids = lambda d: sorted(r["file_id"] for r in d.select("file_id").distinct().collect())
    assert ids(filters.keep_genuine(df, "forgery_type")) == ["a_1_ANG", "b_1_SAD"]
    assert ids(filters.keep_forged(df, "forgery_type")) == ["a_1_ANG", "c_1_SAD", "d_1_HAP"]
    bare = df.drop("forgery_type")
    assert filters.keep_genuine(bare, "forgery_type").count() == 6
    assert filters.keep_forged(bare, "forgery_type").count() == 6
    with pytest.raises(ValueError, match="n_keyframes"):
        filters.require_columns(df, ["file_id", "n_keyframes"])


def test_both_dedup_orders(spark, root):
    src = ManifestSource("one", str(root), "m.csv")
    gone = ManifestSource("later", str(root / "later"), "m.csv")
    df = manifests.scan_registry(spark, [src, gone], file_order=True)
    order = ["source_rank", *manifests.FILE_ORDER]
    label = F.lit(1)
    first = curation.labelled_samples(df, order, label)
    assert [r["file_id"] for r in first.collect()] == ["b_1_SAD"]
    pairs = curation.pair_samples(df, df.limit(0), order)
    assert sorted(r["file_id"] for r in pairs.collect()) == ["a_1_ANG", "b_1_SAD"]
    both = curation.pair_samples(df, df, order).filter("label = 1")
    assert sorted(r["file_id"] for r in both.collect()) == ["a_1_ANG", "c_1_SAD", "d_1_HAP"]


def test_manifest_without_its_id_column(spark, root):
    good = ManifestSource("good", str(root), "m.csv")
    bad = ManifestSource("bad", str(root), "m.csv", id_col="clip")
    with pytest.raises(ValueError, match="clip"):
        manifests.scan_registry(spark, [good, bad])
    rows = manifests.scan_registry(spark, [good, bad], skip_invalid=True)
    assert rows.select("source").distinct().collect() == [("good",)]


def test_unknown_labels_drop_out(spark):
    df = spark.createDataFrame([("s", "x", " Joy "), ("s", "y", "unknown"), ("s", "z", None)],
                               "source string, file_id string, emotion string")
    out = curation.labelled_samples(df, ["emotion"], label_from_text("emotion", SEVEN_CLASSES), None, False)
    assert [(r["file_id"], r["emotion"]) for r in out.collect()] == [("x", 3)]


def test_routing_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a", "4", "train"), ("b", "3", None), ("c", "x", "dev"), ("d", "1_0", "dev")],
                               "id string, n_keyframes string, split string")
    routed = filters.route_min_count(df, "n_keyframes")
    assert {r["id"]: r["route"] for r in routed.collect()} == {
        "a": "kept", "b": "disregarded", "c": "disregarded", "d": "kept"}
    got = {tuple(r[:2]): r["n"] for r in filters.route_summary(routed, ["route", "split"]).collect()}
    assert got[("disregarded", "?")] == 1
    manifests.write_routed(routed, "route", str(tmp_path / "out"))
    back = manifests.scan_manifest(spark, str(tmp_path / "out" / "route=kept"))
    assert sorted(r["id"] for r in back.collect()) == ["a", "d"] and back.columns == df.columns
    manifests.write_report(routed, str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("part-*.csv"))) == 1


@pytest.mark.parametrize("path, mb, reason", [
    ("a/b.MP4", 500, None), ("a/b.mp4", 500.1, "file too large"), ("a.mp4/b", 1, "unsupported format"),
    ("a/.mp4", 1, "unsupported format"), ("a/b.tar.mkv", 1, None)])
def test_admit(spark, path, mb, reason):
    df = spark.createDataFrame([(path, int(mb * 1e6))], "path string, length long")
    assert filters.admit(df, "path", "length").first()["reject_reason"] == reason


# -- assets ------------------------------------------------------------------------------

SRC_NAME = "corpus"


def save(path, array):
    path.parent.mkdir(parents=True, exist_ok=True)
    np.save(path, array)


def sample(base, sid, audio="_melspec.npy", mel=None, ids=(1, 128), mask=(1, 128), frames=2,
           weights="keyframe_weights.npy", alpha=None):
    if mel is not False:
        save(base / "audio" / f"{sid}{audio}", np.zeros((80, 130), np.float32) if mel is None else mel)
    if ids:
        save(base / "text" / f"{sid}_input_ids.npy", np.zeros(ids, np.int64))
    if mask:
        save(base / "text" / f"{sid}_attention_mask.npy", np.zeros(mask, np.int64))
    folder = base / "visual" / sid
    folder.mkdir(parents=True, exist_ok=True)
    for i in range(frames):
        (folder / f"frame_{i}.jpg").write_bytes(b"jpg")
    if weights and weights.endswith(".npy"):
        save(folder / weights, np.full(max(frames, 1), 0.5, np.float32) if alpha is None else alpha)
    elif weights:
        (folder / weights).write_text(json.dumps({"frame_0.jpg": {"alpha": 1.0}}))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    train, dev = root / "train", root / "dev"
    sample(train, "both_names")
    save(train / "audio" / "both_names.flv_melspec.npy", np.zeros((80, 140), np.float32))
    sample(train, "late", ids=None, mask=None)              # partial in train
    sample(dev, "late")                                     # complete in dev
    sample(dev, "json", weights="attention_weights.json")
    sample(train, "no_weights", weights=None)
    sample(train, "no_frames", frames=0)
    nan = np.zeros((80, 130), np.float32)
    nan[0, 0] = np.nan
    sample(train, "nan", mel=nan)
    inf = np.full((79, 130), np.inf, np.float32)
    sample(train, "inf79", mel=inf)
    sample(train, "mismatch", mask=(1, 64))
    sample(train, "junk", mel=False)
    (train / "audio" / "junk_melspec.npy").write_bytes(b"not an array")
    sample(train, "bad_weights", alpha=np.array([np.nan, 1.0], np.float32))
    (train / "visual" / "both_names" / "frame_9.png").write_bytes(b"")
    return root


def source(tree):
    return ManifestSource(SRC_NAME, str(tree), "m.csv", subdirs=("train", "dev", "test"))


IDS = ["both_names", "late", "json", "no_weights", "no_frames", "nan", "inf79", "mismatch", "junk",
       "bad_weights", "gone"]


@pytest.fixture(scope="module")
def manifest(spark):
    return spark.createDataFrame([(SRC_NAME, i) for i in IDS], "source string, file_id string")


def test_listing_reads_no_contents(spark, tree):
    df = assets.list_assets(spark, source(tree))
    assert "content" not in df.columns
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_complete_samples(spark, tree, manifest):
    got = {r["file_id"]: r for r in
           resolve.complete_samples(manifest, assets.list_assets(spark, source(tree))).collect()}
    assert set(got) == set(IDS) - {"no_frames", "gone"}
    assert got["both_names"]["audio"].endswith("/train/audio/both_names.flv_melspec.npy")
    assert got["late"]["base"].endswith("/dev") and got["late"]["audio"].endswith("/dev/audio/late_melspec.npy")
    assert (got["json"]["weights_kind"], got["no_weights"]["weights_kind"]) == ("json", "uniform")
    assert got["no_weights"]["weights"] is None and got["both_names"]["n_frames"] == 2


def test_coverage_takes_the_first_base_with_anything(spark, tree, manifest):
    listing = assets.list_assets(spark, source(tree))
    got = {r["file_id"]: r for r in resolve.coverage(manifest, listing).collect()}
    assert got["late"]["coverage"] == "partial" and got["late"]["base"].endswith("/train")
    assert got["gone"]["coverage"] == "absent" and got["both_names"]["coverage"] == "full"
    assert [r["file_id"] for r in resolve.absent(manifest, listing).collect()] == ["gone"]
    s = resolve.coverage_summary(resolve.coverage(manifest, listing)).first()
    assert (s["n_full"], s["n_partial"], s["n_absent"]) == (8, 2, 1)


def test_issues(spark, tree, manifest):
    found = curation.health_check(manifest, assets.list_assets(spark, source(tree), content=True))
    got = sorted((r["file_id"], r["modality"], r["issue"]) for r in found.collect())
    assert got == sorted([
        ("no_weights", "visual", "no weights file"),
        ("no_frames", "visual", "no frames"),
        ("nan", "audio", "NaN"),
        ("inf79", "audio", "mel_bands=79"), ("inf79", "audio", "Inf"),
        ("mismatch", "text", "shape mismatch (1, 128) vs (1, 64)"),
        ("junk", "audio", "load_error:ValueError"),
        ("bad_weights", "visual:weights", "NaN")])
    top = health.issue_summary(found).first()
    assert (top["issue"], top["n"]) == ("NaN", 2)
    assert health.issue_examples(found, 3).count() == 3
    with pytest.raises(ValueError, match="8 integrity"):
        health.assert_healthy(found)
    health.assert_healthy(found.filter("false"))


def test_failed_audio_is_not_coverage(spark):
    rows = [("corpus", "/c/train", 0, "x", "audio", 0, "ValueError"), ("corpus", "/c/dev", 1, "x", "audio", 1, None)]
    listing = spark.createDataFrame(
        rows, "source string, base string, base_rank int, file_id string, kind string, variant int, err string")
    m = spark.createDataFrame([("corpus", "x")], "source string, file_id string")
    assert resolve.coverage(m, listing).first()["base"] == "/c/dev"


def test_decode_arrays(spark, tree):
    listing = assets.list_assets(spark, source(tree), content=True).filter("kind = 'audio'")
    got = {r["file_id"]: r for r in arrays.decode_arrays(listing).filter("file_id IN ('junk', 'inf79')").collect()}
    assert got["junk"]["array"]["err"] == "ValueError" and got["junk"]["array"]["data"] is None
    assert got["inf79"]["array"]["shape"] == [79, 130] and len(got["inf79"]["array"]["data"]) == 79 * 130


def test_bands_from_flat_data(spark):
    df = spark.sql("SELECT named_struct('shape', array(2, 3), 'data', "
                   "array(1f, 2f, 3f, 4f, 5f, 6f)) AS a")
    assert df.select(arrays.bands("a").alias("b")).first()["b"] == [[1, 2, 3], [4, 5, 6]]


def test_weights(spark):
    text = json.dumps({"frame_2": {"alpha": 0.25}, "frame_1": {}, "frame_3": {"alpha": 1}})
    got = spark.createDataFrame([(text,)], "t string").select(arrays.parse_weight_map("t").alias("w")).first()["w"]
    assert [tuple(x) for x in got] == [("frame_1", 0.0), ("frame_2", 0.25), ("frame_3", 1.0)]
    frames = spark.createDataFrame([(k, f"frame_{i}") for k, n in (("fit", 3), ("off", 2), ("none", 10))
                                    for i in reversed(range(n))], "id string, frame string")
    w = spark.createDataFrame([("fit", [0.1, 0.2, 0.7]), ("off", [1.0])], "id string, w array<double>")
    for k in (8, None):
        got = {}
        for r in resolve.attach_weights(frames, w, "id", "frame", "w", k).collect():
            got.setdefault(r["id"], {})[r["frame"]] = r["alpha"]
        assert got["fit"] == {"frame_0": 0.1, "frame_1": 0.2, "frame_2": 0.7}
        assert got["off"] == {"frame_0": 0.5, "frame_1": 0.5}
        assert set(got["none"].values()) == {0.1} and len(got["none"]) == (k or 10)


def test_inventory(spark):
    want = spark.createDataFrame([("a",), ("b",)], "name string")
    have = spark.createDataFrame([("a",), ("a",), ("x",)], "name string")
    assert sorted(map(tuple, assets.inventory(want, have, ["name"]).collect())) == [("a", "present"), ("b", "MISSING")]


def odd_tree(root):
    for base in ("train", "train/visual", "dev"):
        for d in ("audio", "text", "visual/a", "visual/a b=%20", "visual/_hidden", "visual/empty", "visual/audio", "visual/a/deep"):
            (root / base / d).mkdir(parents=True, exist_ok=True)
        for f in ("audio/a.flv_melspec.npy", "audio/_b_melspec.npy", "audio/_c=1_melspec.npy", "audio/.d_melspec.npy", "audio/note.txt",
                  "text/a b=%20_input_ids.npy", "text/ü_attention_mask.npy", "visual/loose.jpg", "visual/a/frame_1.jpg", "visual/a/.hid",
                  "visual/a b=%20/frame_1.jpg", "visual/a b=%20/attention_weights.json", "visual/_hidden/frame_1.jpg",
                  "visual/audio/z_melspec.npy", "visual/a/deep/frame_2.jpg", "other.npy"):
            (root / base / f).write_bytes(f.encode())
    (root / "outside_melspec.npy").write_bytes(b"x")


@pytest.mark.parametrize("subdirs", [("train", "dev", "gone"), ("train", "train/visual"), ()])
@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_listing_in_tasks_equals_sparks(spark, tmp_path, subdirs, scheme):
    odd_tree(tmp_path)
    src = ManifestSource("s", f"{scheme}{tmp_path}{'' if subdirs else '/train'}", "m.csv", subdirs=subdirs)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(src.root)
    want = assets.parse_assets(raw.select("path", "length", "content"), src)
    for content in (False, True):
        got = assets.list_assets(spark, src, content)
        assert got.columns == [c for c in want.columns if content or c != "content"]
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect()) and got.count() > 5


def test_odd_roots(spark, tmp_path):
    with pytest.raises(Exception, match="no folder"):
        assets.list_assets(spark, ManifestSource("s", str(tmp_path / "gone"), "m.csv"))
    assert assets.list_assets(spark, ManifestSource("s", str(tmp_path), "m.csv")).count() == 0
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio/a_melspec.npy").write_bytes(b"x")
    (tmp_path / "audio" / os.fsdecode(b"\xff_melspec.npy")).write_bytes(b"x")
    listing = assets.list_assets(spark, ManifestSource("s", str(tmp_path), "m.csv"), content=True)
    assert listing.count() == 2
    (tmp_path / "audio/a_melspec.npy").unlink()
    with pytest.raises(Exception, match="cannot read .*a_melspec.npy: FileNotFoundError"):
        listing.filter("file_id = 'a'").collect()


def test_listing_needs_few_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"visual/{i}").mkdir(parents=True)
        for j in range(4):
            (tmp_path / f"visual/{i}/frame_{j}.jpg").write_bytes(b"")
    listing = assets.list_assets(spark, ManifestSource("s", str(tmp_path), "m.csv"))
    assert listing.count() == 1600
    assert listing.rdd.getNumPartitions() <= 16
