"""Hard-negative mining against a search over all pairs, and the bounds themselves."""

import math

import numpy as np

from plumbline.llm import negatives
from plumbline.llm.negatives import Mining


def brute(rows, is_anchor, m):
    """All rows by score for every anchor, in plain Python."""
    rows = [(i, lab, [math.floor(m.scale * x) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, lab, v) in enumerate(rows):
        if not is_anchor(i):
            continue
        each = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other == lab)
                      for k, (j, other, w) in enumerate(rows) if k != at)
        for s, j, _ in [e for e in each if e[2]][:m.positives]:
            fit = [(-t, n) for t, n, same in each if not same and m.low * -s <= 100 * -t <= m.high * -s]
            out += [(i, j, r, n, -s, t) for r, (t, n) in enumerate(fit[:m.negatives], 1)]
    return sorted(out)


def mined(spark, rows, is_anchor, m):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    return sorted(tuple(r) for r in negatives.mine_negatives(df, is_anchor, m).collect())


def drawn(n, d, seed, kinds=4, spread=0.2):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(kinds, d))
    labels = draw.integers(0, kinds, n)
    return [(int(i), int(draw.integers(0, kinds)), list(map(float, middles[lab] + spread * draw.normal(size=d))))
            for i, lab in enumerate(labels)]


def test_all_parameters_small(spark):
    rows = drawn(400, 6, 1)
    m = Mining(chunk=7, tree=5, block=37)
    assert mined(spark, rows, lambda i: i % 10 == 0, m) == brute(rows, lambda i: i % 10 == 0, m) != []


def test_ties_repeats_and_odd_rows(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i) // 2, int(draw.integers(0, 3)), list(map(float, draw.integers(-2, 3, 3)))) for i in range(160)]
    rows += rows[:20]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (10, None, [1.0, 1.0, 1.0]), (20, 1, None), (30, 1, [1.0, None, 1.0]),
             (40, 1, [1.0, float("nan"), 1.0]), (50, 1, [float("inf"), 1.0, 1.0]), (60, 2, []), (70, 2, [0.0] * 3)]
    m = Mining(scale=1, positives=3, negatives=4, tree=3, block=11)
    assert mined(spark, rows, lambda i: i % 5 == 0, m) == brute(rows, lambda i: i % 5 == 0, m) != []


def test_empty_and_without_anchors(spark):
    assert mined(spark, [], lambda i: i % 10 == 0, Mining()) == []
    rows = drawn(20, 3, 3)
    assert mined(spark, rows, lambda i: i < 0, Mining()) == []
    # One label only: positives, but no negatives.
    assert mined(spark, [(i, 0, v) for i, _, v in rows], lambda i: i == 0, Mining()) == []


def test_clashing_columns(spark):
    rows = drawn(60, 4, 4)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "vec_id long, label int, embedding array<double>, rank int, llm_row string")
    got = sorted(tuple(r) for r in negatives.mine_negatives(df, lambda i: i % 10 == 0).collect())
    assert got == brute(rows, lambda i: i % 10 == 0, Mining())


def test_large_components_stay_exact(spark):
    draw = np.random.default_rng(5)
    rows = [(i, i % 2, [float(x) for x in draw.integers(-60_000, 60_000, 8)]) for i in range(80)]
    m = Mining(low=0, high=100)
    assert mined(spark, rows, lambda i: i % 9 == 0, m) == brute(rows, lambda i: i % 9 == 0, m) != []


def test_tree_bounds_hold_and_spare_work():
    draw = np.random.default_rng(6)
    middles = draw.normal(size=(3, 8)) * 100
    anchors = np.floor(np.repeat(middles, 20, axis=0) + draw.normal(size=(60, 8)))
    forest = negatives.plant(np.arange(60), np.zeros(60, np.int64), anchors, 64)
    assert (forest.parent < np.arange(60)).all() and (forest.parent[1:] >= 0).all()
    rows = np.floor(draw.normal(size=(500, 8)) * 100)
    true = rows @ forest.vector.T
    norms = np.sqrt((rows * rows).sum(axis=1))
    seen = {}
    scored = negatives.walk(forest, rows, norms, lambda a: (20_000.0, 30_000.0, np.ones(500, bool)),
                            lambda a, at, scores: seen.__setitem__(a, (set(at.tolist()), (true[at, a] == scores).all())))
    for a in range(60):
        inside = set(np.flatnonzero((true[:, a] >= 20_000) & (true[:, a] <= 30_000)).tolist())
        assert inside <= seen[a][0] and seen[a][1]
    assert scored < 0.7 * true.size
