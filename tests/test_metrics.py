"""Evaluation operators against numpy, with ties, empty classes and forced value ranges."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.functions.keys import GENUINE, SPLICED, TAMPERED
from plumbline.operators import binary, classify, compare

FEW = settings(max_examples=5, deadline=None,
               suppress_health_check=[HealthCheck.function_scoped_fixture])


def auc_of(rows):
    pos = np.array([p for y, p in rows if y == 1])
    neg = np.array([p for y, p in rows if y == 0])
    if not len(pos) or not len(neg):
        return None
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


def same(a, b):
    return (a is None and b is None) or math.isclose(a, b, abs_tol=1e-9)


def rates(rows):
    tp = sum(y == 1 and p >= 0.5 for y, p in rows)
    fp = sum(y == 0 and p >= 0.5 for y, p in rows)
    fn = sum(y == 1 and p < 0.5 for y, p in rows)
    tn = len(rows) - tp - fp - fn
    prec, rec = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
    return tp, tn, fp, fn, (tp + tn) / max(len(rows), 1), prec, rec, 2 * prec * rec / max(prec + rec, 1e-8)


@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([-3.0, 0.0, -0.0, 0.5, 0.5001, 2.0, 1e9])),
                min_size=1, max_size=40))
@FEW
def test_auc_with_ties_and_tiny_ranges(spark, rows):
    df = spark.createDataFrame(rows, "y int, p double")
    for range_rows in (2, 500_000):
        assert same(binary.auc(df, "y", "p", range_rows=range_rows).first()["auc"], auc_of(rows))
    flipped = binary.auc(df.selectExpr("y", "-p AS p"), "y", "p").first()["auc"]
    assert flipped is None or math.isclose(flipped, 1 - auc_of(rows), abs_tol=1e-9)


def test_auc_by_group_with_many_scores(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(2000)]
    rows += [("one", 1, 0.3), ("one", 1, 0.4)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r["g"]: r for r in binary.auc(df, "y", "p", ["g"], range_rows=20).collect()}
    for g in ("a", "b", "one"):
        assert same(got[g]["auc"], auc_of([(y, p) for h, y, p in rows if h == g]))
    assert got["one"]["n_neg"] == 0


def test_binary_metrics_edges(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 0.49), (0, 0.1)]
    r = binary.binary_metrics(spark.createDataFrame(rows, "y int, p double"), "y", "p").first()
    assert [r[c] for c in ("tp", "tn", "fp", "fn", "acc", "precision", "recall", "f1")] == list(rates(rows))
    none = spark.createDataFrame([(0, 0.1)], "y int, p double")
    r = binary.binary_metrics(none, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"]) == (0, 0, 0)


def subgroup_rows(seed):
    rng = random.Random(seed)
    rows = []
    for ds, n in (("A", 90), ("B", 60)):
        for _ in range(n):
            t = rng.choice([GENUINE, TAMPERED] if ds == "B" else [GENUINE, TAMPERED, SPLICED])
            rows.append((ds, t, int(t != GENUINE), round(rng.random(), 1)))
    return rows


@pytest.mark.parametrize("range_rows", [3, 500_000])
def test_one_vs_reference(spark, range_rows):
    rows = subgroup_rows(1)
    df = spark.createDataFrame(rows, "ds string, t string, y int, p double")
    got = {(r["ds"], r["t"]): r for r in binary.one_vs_reference(
        df, "ds", "t", "y", "p", range_rows=range_rows).collect()}
    assert set(got) == {(d, t) for d, t, _, _ in rows} | {("OVERALL", "all pairs")}
    for (ds, t), r in got.items():
        if t == GENUINE:
            own = [p for d, k, _, p in rows if (d, k) == (ds, t)]
            assert r["n"] == len(own) and same(r["acc"], sum(p < 0.5 for p in own) / len(own))
            assert r["auc"] is None and r["f1"] is None
            continue
        sel = [(y, p) for d, k, y, p in rows
               if ds == "OVERALL" or (d == ds and (k == t or y == 0))]
        *_, acc, prec, rec, f1 = rates(sel)
        assert r["n"] == len(sel) and same(r["auc"], auc_of(sel))
        assert all(same(r[c], v) for c, v in
                   (("acc", acc), ("precision", prec), ("recall", rec), ("f1", f1)))


@pytest.mark.parametrize("range_rows", [2, 500_000])
def test_roc_points(spark, range_rows):
    rows = [(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.4), (0, 0.2), (1, 0.2)]
    df = spark.createDataFrame(rows, "y int, p double")
    got = [tuple(r) for r in binary.roc_points(df, "y", "p", range_rows=range_rows)
           .orderBy("tpr", "fpr").collect()]
    third = 1 / 3
    assert [g[0] for g in got] == [None, 0.9, 0.7, 0.4, 0.2]
    assert np.allclose([g[1:] for g in got], [
        (0, 0), (third, third), (third, 2 * third), (2 * third, 2 * third), (1, 1)])


def test_roc_by_kind_has_every_curve(spark):
    df = spark.createDataFrame(subgroup_rows(2), "ds string, t string, y int, p double")
    out = binary.roc_by_kind(df, "t", "y", "p", range_rows=3)
    ends = {r["t"]: (r["max(fpr)"], r["max(tpr)"]) for r in
            out.groupBy("t").agg({"fpr": "max", "tpr": "max"}).collect()}
    assert ends == {TAMPERED: (1, 1), SPLICED: (1, 1), "all pairs": (1, 1)}


def test_confusion_by_and_losses(spark):
    df = spark.createDataFrame([("g", 0.5), ("g", 0.1), ("t", 0.9)], "t string, p double")
    got = {r["t"]: (r["pred_genuine"], r["pred_fake"], r["share_fake"]) for r in
           binary.confusion_by(df, "t", "p").collect()}
    assert got == {"g": (1, 1, 0.5), "t": (0, 1, 1.0)}
    big = spark.createDataFrame([(1, 800.0), (0, -800.0), (1, 0.0)], "y int, x double")
    assert math.isclose(binary.log_loss(big, "y", "x").first()["loss"], math.log(2) / 3)
    ce = spark.createDataFrame([(1, [0.0, 1000.0])], "y int, l array<double>")
    assert math.isclose(classify.cross_entropy(ce, "y", "l").first()["loss"], 0, abs_tol=1e-9)


PAIRS = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)]


def test_confusion_grid(spark):
    df = spark.createDataFrame(PAIRS, "y int, pred int")
    m = np.zeros((4, 4), dtype=int)
    for r in classify.confusion(df, "y", "pred", 4).collect():
        m[r["y"], r["pred"]] = r["n"]
    assert m.tolist() == [[1, 1, 0, 0], [0, 2, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0]]
    n = {(r["y"], r["pred"]): r["share"] for r in
         classify.confusion(df, "y", "pred", 4, normalize=True).collect()}
    assert n[(0, 1)] == 0.5 and n[(3, 3)] == 0 and n[(2, 0)] == 1


def test_per_class_and_f1(spark):
    df = spark.createDataFrame(PAIRS, "y int, pred int")
    got = {r["class"]: r for r in classify.per_class_prf(df, "y", "pred", 4).collect()}
    want = {}
    for c in range(4):
        tp = sum(y == c == p for y, p in PAIRS)
        prec = tp / max(sum(p == c for _, p in PAIRS), 1)
        rec = tp / max(sum(y == c for y, _ in PAIRS), 1)
        want[c] = (prec, rec, 2 * prec * rec / max(prec + rec, 1e-8), sum(y == c for y, _ in PAIRS))
    for c, w in want.items():
        assert np.allclose([got[c][k] for k in ("precision", "recall", "f1", "support")], w)
    s = classify.f1_scores(df, "y", "pred", 4).first()
    assert math.isclose(s["macro_f1"], sum(w[2] for w in want.values()) / 4)
    assert math.isclose(s["weighted_f1"], sum(w[2] * w[3] for w in want.values()) / 5)
    assert math.isclose(s["acc"], 0.6) and s["n"] == 5
    acc = {r["class"]: (r["acc"], r["n"]) for r in classify.per_class_accuracy(df, "y", "pred", 4).collect()}
    assert acc[3] == (0, 1)


def test_f1_without_rows(spark):
    df = spark.createDataFrame([], "y int, pred int")
    s = classify.f1_scores(df, "y", "pred", 3).first()
    assert (s["weighted_f1"], s["n"]) == (0, 0)


def test_summary_keeps_missing_models(spark):
    df = spark.createDataFrame([("m", 0, 0)], "model string, y int, pred int")
    expected = spark.createDataFrame([("m",), ("absent",)], "model string")
    got = {r["model"]: (r["acc_pct"], r["n"]) for r in
           classify.summary(df, "y", "pred", 2, ["model"], expected).collect()}
    assert got == {"m": (100.0, 1), "absent": (None, 0)}


def test_compare_published(spark):
    ours = spark.createDataFrame([("speech_text", "CREMA", 70.0), ("speech_text", "DFDC", 1.0),
                                  ("visual", "MELD", None)], "tab string, dataset string, ours double")
    published = spark.createDataFrame(compare.PUBLISHED, "tab string, dataset string, published double")
    got = {(r["tab"], r["dataset"]): r["diff"] for r in
           compare.compare(ours, published, ["tab", "dataset"]).collect()}
    assert got == {("speech_text", "CREMA"): -4.67, ("speech_text", "DFDC"): None,
                   ("visual", "MELD"): None}


def test_rows_without_score_or_label_are_counted(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", None, 0.5), ("a", 0, None), ("b", None, None)], "g string, y int, p double")
    got = {r.g: tuple(r)[1:] for r in binary.count_unscored(df, "y", "p", ["g"]).collect()}
    assert got == {"a": (1, 1, 2, 3), "b": (1, 1, 1, 1)}
    whole = binary.auc(df, "y", "p").first()
    assert (whole.n_pos, whole.n_neg) == (1, 0)
