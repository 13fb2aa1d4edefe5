import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.llm import codes, vectors

ROWS = "vec_id long, embedding array<float>, label int, code string, x string, id string"


def brute(rows, parts=4, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].copy()  # [entry, part, position]
    for done in range(rounds + 1):
        d = ((x[:, None] - books[None]) ** 2).sum(-1)  # [row, entry, part]
        code = d.argmin(1)
        if done < rounds:
            for p in range(parts):
                for e in range(len(books)):
                    if (mine := x[code[:, p] == e, p]).size:
                        books[e, p] = [int(s) // len(mine) for s in mine.sum(0)]
    error = d.min(1).sum(1)
    return [(r[0], r[2], code[i].tolist(), int(error[i])) for i, r in enumerate(kept)], books.transpose(1, 0, 2)


def found(spark, rows, parts=4, **given):
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], ROWS)
    out, books = codes.compress(df, parts=parts, **given)
    return [(r["id"], r["label"], list(r["code"]), r["error"]) for r in out.collect()], books, out


def clustered(n, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 2, (9, width))
    return [(i, (centers[i % 9] + rng.normal(0, 0.1, width)).astype(np.float32).tolist(), i % 3 if i % 11 else None) for i in range(n)]


@pytest.mark.parametrize("n, entries, rounds", [(300, 64, 2), (300, 7, 4), (20, 64, 2), (1, 64, 2)])
def test_matches_brute_force(spark, n, entries, rounds):
    rows = clustered(n)
    want, books = brute(rows, entries=entries, rounds=rounds)
    got, mine, _ = found(spark, rows, entries=entries, rounds=rounds)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert (mine == books).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = clustered(40, 8)
    rows = [*good, *good[:3], (None, good[5][1], None), (None, None, 1), (50, [], 1), (51, [1.0] * 7 + [None], 1), (52, [nan] * 8, 1), (53, [inf] * 8, 1), (54, [-0.001] * 8, 2), (55, [1e30] * 8, 2)]
    want, books = brute([r for r in rows if not r[1] or r[1][0] != 1e30])
    got, mine, _ = found(spark, rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert (mine == books).all()
    assert found(spark, [*good, (60, [1.0] * 12, 1)])[0] == found(spark, good)[0]  # another length than the smallest id's


def test_no_rows_and_lengths(spark):
    for rows in ([], [(1, None, 1)]):
        got, books, _ = found(spark, rows)
        assert got == [] and books.size == 0
    with pytest.raises(ValueError, match="equal parts"):
        found(spark, [(1, [1.0] * 6, 1)])


def test_label_error_and_reconstruction(spark):
    rows = clustered(120)
    got, books, out = found(spark, rows)
    sums = defaultdict(int)
    for _, label, _, error in got:
        sums[label] += error
    assert {(r["label"], r["label_error"]) for r in codes.with_label_error(out).collect()} == set(sums.items())
    for r in codes.reconstruct(out, books).select("id", "code", "x").collect():
        assert r["x"] == [v for p, e in enumerate(r["code"]) for v in books[p, e].tolist()]


def test_bounds_are_safe_tighter_than_drifts_and_used():
    rng = np.random.default_rng(3)
    x = (rng.integers(0, 6, (4000, 1)) * 300 + rng.integers(-30, 30, (4000, 8))).reshape(-1, 2, 4).astype(np.int64)
    books = x[:32].transpose(1, 0, 2).copy()
    history, groups = books[None], 4
    code, least, stamp = np.zeros((4000, 2), dtype=np.int64), np.zeros((4000, 2, groups), dtype=np.float32), np.full((4000, 2, groups), -1, dtype=np.int8)
    work = []
    for _ in range(6):
        code, least, stamp, error, measured = codes.assign(x, history, code, least, stamp)
        d = ((x[:, :, None, :] - history[-1][None]) ** 2).sum(-1)
        assert (code == d.argmin(-1)).all() and (error == d.min(-1).sum(-1)).all()
        work.append(measured)
        moved = history[-1].copy()
        for p in range(2):
            for e in range(32):
                if (mine := x[code[:, p] == e, p]).size:
                    moved[p, e] = mine.sum(0) // len(mine)
        history = np.concatenate([history, moved[None]])
        net = codes.displacements(history)
        steps = np.sqrt(((history[1:] - history[:-1]) ** 2).sum(-1).astype(float))
        drifts = np.stack([steps[at:].sum(0).reshape(2, groups, -1).max(-1) for at in range(len(history))])
        assert (net <= drifts + 1e-9).all()
        if len(history) > 3:
            assert (net[0] < drifts[0] - 1e-6).any()
    assert work[0] == 4000 * 2 * groups and max(work[2:]) < work[0] / 2


def test_usable(spark):
    rows = [([1.0, 2.0],), ([1.0, None],), (None,), ([],), ([float("-inf")],), ([float(1 << 30)],)]
    df = spark.createDataFrame(rows, "v array<double>").select(vectors.usable(F.col("v")).alias("ok"))
    assert [r["ok"] for r in df.collect()] == [True, False, False, False, False, False]
