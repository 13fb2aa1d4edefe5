import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int, id string, score string, turn string, cell string, query string, place string"


def brute(rows, every=10, floor=80):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    first = lambda c: (-c[1], c[0] is None, c[0] or 0)
    for a, (anchor, x, label) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = [(i, sum(p * q for p, q in zip(x, y, strict=True)), other == label) for b, (i, y, other) in enumerate(kept) if b != a]
        for positive, ps, _ in sorted((s for s in scored if s[2]), key=first)[:5]:
            fits = sorted((s for s in scored if not s[2] and floor * ps <= 100 * s[1] <= 100 * ps), key=first)[:5]
            out += [(anchor, positive, k, n, ps, ns) for k, (n, ns, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def found(spark, rows, every=10, **given):
    df = spark.createDataFrame([(*r, *[None] * 6) for r in rows], ROWS)
    out = negatives.hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"), **given)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def points(n, spread, width=8, labels=4, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (labels, width))
    return [(i, (centers[i % 3] + rng.normal(0, spread, width)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 0.5, 3.0])
def test_matches_brute_force(spark, spread):
    rows = points(400, spread)
    want = brute(rows)
    assert want
    assert found(spark, rows) == want
    assert found(spark, rows, refs=1) == want


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = points(300, 0.5)
    monkeypatch.setattr(negatives, "ROWS", 30)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    assert found(spark, rows) == brute(rows)


def test_ties_copies_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = points(60, 0.3)
    rows = [
        *good, *good[:12], (None, good[10][1], good[10][2]), (None, good[10][1], 3 - good[10][2]), (100, good[20][1], 9), (110, [0.0] * 8, 1), (111, [0.0] * 8, 1), (112, [0.0] * 8, 2),
        (120, None, 1), (130, [], 1), (140, [1.0] * 7 + [None], 1), (150, [nan] * 8, 1), (160, [-inf] * 8, 1), (170, good[3][1], None),
    ]
    want = brute(rows)
    assert any(r[0] == 110 for r in want)  # a score of nothing against nothing
    assert found(spark, rows) == want


def test_one_label_or_none(spark):
    one = [(i, [1.0, float(i)], 1) for i in range(50)]
    assert found(spark, one) == [] == found(spark, []) == found(spark, [(0, [1.0], 1)])
    assert found(spark, [(i, None, 1) for i in range(5)]) == []


def test_bounds_hold_and_leave_out():
    rng = np.random.default_rng(7)
    centers = rng.normal(0, 100, (6, 16))
    x = np.floor(centers[rng.integers(0, 6, 3000)] + rng.normal(0, 3, (3000, 16)))
    x[:3] = 0
    refs = negatives.references(x)
    norm, turn = negatives.angles(x, refs)
    exact = x[:50] @ x.T
    lower, upper = negatives.score_bounds(norm[:50], turn[:50], (norm, turn), (norm, turn))
    assert (lower <= exact).all() and (exact <= upper).all()
    best = np.sort(exact[5:], axis=1)[:, -5:-4]
    assert (upper[5:] >= best).mean() < 0.4  # on clustered rows most need no scoring
    cells = turn.argmin(1)
    for c in np.unique(cells):
        mine = cells == c
        lows, highs = (norm[mine].min()[None], turn[mine].min(0)[None]), (norm[mine].max()[None], turn[mine].max(0)[None])
        lower, upper = negatives.score_bounds(norm[:50], turn[:50], lows, highs)
        assert (lower <= exact[:, mine]).all() and (exact[:, mine] <= upper).all()


def test_large_components_are_exact():
    a, b = np.array([1 << 26, (1 << 26) - 1]), np.array([[1 << 26, 1 << 26], [3, -(1 << 26)]])
    size = float(np.linalg.norm(a) * np.linalg.norm(b, axis=1).max())
    assert negatives.scores(a, b, size).tolist() == [int(a[0]) * int(r[0]) + int(a[1]) * int(r[1]) for r in b]
