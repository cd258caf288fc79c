"""Column functions on hand-written values, checked against plain Python and numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import keys, scores
from plumbline.functions import vectors as V

FEW = settings(max_examples=8, deadline=None,
               suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, **values):
    """Evaluate a column over one row of literal values."""
    df = spark.range(1)
    for name, v in values.items():
        if isinstance(v, (list, tuple)):
            depth2 = v and isinstance(v[0], (list, tuple))
            kind = "array<array<double>>" if depth2 else "array<double>"
            text = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in v]) if depth2 else \
                F.array(*[F.lit(x if isinstance(x, bool) else float(x)) for x in v])
            df = df.withColumn(name, text if v and isinstance(v[0], bool) else text.cast(kind))
        else:
            df = df.withColumn(name, F.lit(v))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("fid, source, donor", [
    ("1001_DFA_ANG_XX", "1001", "1001"),
    ("1046_IWW_ANG_forged_X", "1046", "1046"),
    ("1012_A_ANG_XX___1003_B_SAD_XX", "1012", "1003"),
    ("1001_IEO", "1001", "1001"),
    ("a____b", "a", ""),
    ("plain", "plain", "plain"),
])
def test_groups(spark, fid, source, donor):
    assert one(spark, keys.source_group("f"), f=fid) == source
    assert one(spark, keys.donor_group("f"), f=fid) == donor


@pytest.mark.parametrize("fid, label", [
    ("1001_DFA_ANG_XX", 0), ("1_2_SAD", 5), ("1001_IEO", None), ("1_2_XXX_ANG", None), ("", None)])
def test_label_from_token(spark, fid, label):
    assert one(spark, keys.label_from_token("f", keys.SIX_CLASSES), f=fid) == label


@pytest.mark.parametrize("text, label", [
    (" Joy\n", 3), ("ANGER", 0), ("unknown", None), ("", None), (None, None)])
def test_label_from_text(spark, text, label):
    col = keys.label_from_text(F.col("f").cast("string"), keys.SEVEN_CLASSES)
    assert one(spark, col, f=text) == label


def test_encode_decode_display(spark):
    assert one(spark, keys.display_name("f"), f="FEA") == "Fearful"
    assert one(spark, keys.display_name("f"), f="fea") is None
    assert one(spark, keys.decode_labels("f", ["a", "b"]), f=2) is None
    assert one(spark, keys.decode_labels("f", ["a", "b"]), f=-1) is None


@pytest.mark.parametrize("text", [
    "4", " 4 ", "+7", "-3", "4.0", "", "abc", "1_000", "1__0", "_1", None, "99999999999999999999",
    "-99999999999999999999", "\t12\n", "٤"])
def test_count_or_zero(spark, text):
    try:
        want = int(text) if text and text.isascii() else 0
    except ValueError:
        want = 0
    want = max(min(want, 2**63 - 1), -(2**63))
    assert one(spark, keys.count_or_zero(F.col("f").cast("string")), f=text) == want


@given(st.text(alphabet=" \t\n\r\x0b\x1f\x85\xa0 　ab​", max_size=12))
@FEW
def test_strip_equals_python(spark, text):
    assert one(spark, keys.strip("f"), f=text) == text.strip()


def test_text_default_and_cleaning(spark):
    assert one(spark, keys.text_or_default("f"), f=" \n") == "[inaudible]"
    assert one(spark, keys.text_or_default(F.lit(None).cast("string"))) == "[inaudible]"
    assert one(spark, keys.clean_transcript("f"), f="Don't, STOP!") == "dont stop"


def test_dataset_and_pair_type(spark):
    rules = [("meld", "MELD")]
    assert one(spark, keys.dataset_of("f", rules, "OTHER"), f="/data/MELD/x") == "MELD"
    assert one(spark, keys.dataset_of("f", rules, "OTHER"), f="/data/x") == "OTHER"
    assert one(spark, keys.pair_type_from_id(F.lit(1), "f"), f="a___b") == keys.SPLICED
    assert one(spark, keys.pair_type(F.lit(1), F.lit("p1"), "p1")) == keys.TAMPERED
    assert one(spark, keys.pair_type(F.lit(0), F.lit("p1"), "p1")) == keys.GENUINE


@pytest.mark.parametrize("p, v", [(0.5, "FAKE"), (0.49999, "GENUINE"), (1.0, "FAKE")])
def test_verdict(spark, p, v):
    assert one(spark, scores.verdict("p"), p=p) == v


@pytest.mark.parametrize("d, b", [(0.0499, "low"), (0.05, "moderate"), (0.15, "high")])
def test_band(spark, d, b):
    assert one(spark, scores.band("d"), d=d) == b


def test_rounded_delta_rounds_operands_first(spark):
    assert one(spark, scores.rounded_delta(F.lit(0.14), F.lit(0.06), 1)) == 0.0
    assert one(spark, scores.rounded_diff(F.lit(1.0), F.lit(None).cast("double"))) is None


@given(st.lists(st.floats(-100, 100), min_size=1, max_size=9))
@FEW
def test_zscore(spark, xs):
    a = np.array(xs)
    want = (a - a.mean()) / (a.std() + 1e-6)
    assert np.allclose(one(spark, V.zscore("v"), v=xs), want, atol=1e-6)
    assert np.isclose(one(spark, V.std_pop("v"), v=xs), a.std(), atol=1e-9)


def test_zscore_constant_and_bands(spark):
    assert one(spark, V.zscore("v"), v=[3, 3, 3]) == [0, 0, 0]
    m = np.arange(6.0).reshape(2, 3)
    got = one(spark, V.zscore_bands("v"), v=m.tolist())
    assert np.allclose(got, (m - m.mean()) / (m.std() + 1e-6))


@pytest.mark.parametrize("n, width", [(3, 5), (5, 5), (8, 5), (9, 4), (0, 2)])
def test_center_crop(spark, n, width):
    xs = [float(i + 1) for i in range(n)]
    s = (n - width) // 2
    want = xs[s:s + width] if n >= width else xs + [0.0] * (width - n)
    assert one(spark, V.center_crop("v", width), v=xs) == want
    crop = one(spark, V.seeded_crop("v", width, F.lit("k"), 1), v=xs)
    assert len(crop) == width
    if n > width:
        assert crop == xs[int(crop[0]) - 1:int(crop[0]) - 1 + width]
    assert crop == one(spark, V.seeded_crop("v", width, F.lit("k"), 1), v=xs)


def test_seeded_crop_reaches_every_start(spark):
    df = spark.range(200).select(V.seeded_crop(F.array(*[F.lit(float(i)) for i in range(5)]), 3, "id", 9)
                                 .alias("c"))
    assert {r.c[0] for r in df.collect()} == {0.0, 1.0, 2.0}


def test_span_mask(spark):
    grid = [[1.0] * 16 for _ in range(24)]
    rows = spark.range(60).select(V.span_mask(
        F.array(*[F.array(*[F.lit(x) for x in r]) for r in grid]), "id", 3).alias("m")).collect()
    for r in rows:
        m = np.array(r.m)
        full_rows = (m == -80).all(axis=1).sum()
        full_cols = (m == -80).all(axis=0).sum()
        assert full_rows < 3 and full_cols < 2
        assert set(np.unique(m)) <= {1.0, -80.0}
    assert any((np.array(r.m) == -80).any() for r in rows)


def test_padding(spark):
    r = one(spark, V.pad_with_mask("v", 4), v=[1, 2])
    assert r["values"] == [1, 2, 0, 0] and r["mask"] == [True, True, False, False]
    r = one(spark, V.pad_to("v", 2), v=[1, 2, 3])
    assert r["values"] == [1, 2] and r["length"] == 2
    t = one(spark, V.pad_tokens("v", 3), v=[7, 8, 9, 10])
    assert t["input_ids"] == [7, 8, 9] and t["attention_mask"] == [1, 1, 1]
    t = one(spark, V.pad_tokens("v", 3), v=[7])
    assert t["input_ids"] == [7, 0, 0] and t["attention_mask"] == [1, 0, 0]
    assert one(spark, V.pad_mask("v"), v=[1, 0]) == [False, True]


def test_renorm(spark):
    assert one(spark, V.renorm("w", "m"), w=[1, 3, 4], m=[True, True, False]) == [0.25, 0.75, 0]
    assert one(spark, V.renorm("w", "m"), w=[1, 3], m=[False, False]) == [0, 0]


def test_pooling(spark):
    vecs = [[1, 2], [3, 4], [5, 6]]
    assert one(spark, V.weighted_pool("v", "w"), v=vecs, w=[0.5, 0.5, 0]) == [2, 3]
    assert one(spark, V.masked_mean("v", "m"), v=vecs, m=[False, False, True]) == [2, 3]
    assert one(spark, V.masked_mean("v", "m"), v=vecs, m=[True, True, True]) == [0, 0]


def test_fusion_and_distances(spark):
    a, b = [1, -2], [3, 5]
    assert one(spark, V.fuse("a", "b"), a=a, b=b) == [1, -2, 3, 5, 2, 7, 3, -10]
    assert one(spark, V.vsum("a", "b"), a=a, b=b) == [4, 3]
    assert np.isclose(one(spark, V.l2("a", "b"), a=a, b=b), np.hypot(2, 7))
    assert np.isclose(one(spark, V.cosine("a", "b"), a=a, b=b), -7 / np.sqrt(5 * 34))
    assert one(spark, V.cosine("a", "b"), a=[0, 0], b=b) is None


def test_softmax_is_stable(spark):
    got = one(spark, V.softmax("v"), v=[1000, 1000, 999])
    e = np.exp([0, 0, -1.0])
    assert np.allclose(got, e / e.sum())
    assert np.isclose(one(spark, V.log_sum_exp("v"), v=[1000, 1000]), 1000 + np.log(2))
    assert np.allclose(one(spark, V.softmax("v", 5.0), v=[0.1, 0.3]),
                       np.exp([0.5, 1.5]) / np.exp([0.5, 1.5]).sum())


def test_argmax_ties_and_maps(spark):
    assert one(spark, V.argmax("v"), v=[1, 3, 3]) == 1
    m = V.score_map("v", ["x", "y", "z"])
    assert one(spark, m, v=[0.12345, 0.5, 0.5]) == {"x": 0.1235, "y": 0.5, "z": 0.5}
    assert one(spark, V.argmax_key(m, ["x", "y", "z"]), v=[0.1, 0.5, 0.5]) == "y"
    got = one(spark, V.entries_desc(m, ["x", "y", "z"]), v=[0.1, 0.5, 0.5])
    assert [(e["key"], e["value"]) for e in got] == [("y", 0.5), ("z", 0.5), ("x", 0.1)]
    d = V.class_delta(V.score_map("a", ["x", "y"]), V.score_map("b", ["x", "y"]))
    assert one(spark, d, a=[0.1, 0.9], b=[0.3, 0.9]) == {"x": 0.2, "y": 0.0}


def test_uniform_and_bad_values(spark):
    assert one(spark, V.uniform(4)) == [0.25] * 4
    assert one(spark, V.uniform(0)) == []
    nan, inf = float("nan"), float("inf")
    assert one(spark, V.bad_value("v"), v=[1, nan, inf]) == "NaN"
    assert one(spark, V.bad_value("v"), v=[1, -inf]) == "Inf"
    assert one(spark, V.bad_value("v"), v=[1, 2]) is None


def test_flatten(spark):
    assert one(spark, V.flat_long("v"), v=[[1.9, 2], [3, 4]]) == [1, 2, 3, 4]
    assert one(spark, V.flat_float("v"), v=[[1.5, 2], [3, 4]]) == [1.5, 2, 3, 4]
