"""Metric sets and the bootstrap against plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.operators import metrics, resample

SAMPLES = "game_id long, model string, season_year int, week int, p double, home_won int, is_tie boolean, reason string"
R, SEED = 60, 7


def samples(n=300, seed=1):
    chance = random.Random(seed)
    rows = []
    for i in range(n):
        tie, reason = chance.random() < 0.05, chance.choice([None] * 9 + ["no history"])
        rows.append((i, chance.choice(["a", "b"]), chance.choice([2020, 2021, None]), i % 4, None if reason else chance.choice([0.0, 1.0, chance.random()]), None if tie else chance.randrange(2), tie, reason))
    return rows


def weight(game, replicate):
    prime = (1 << 31) - 1
    h = int(hashlib.md5(f"{SEED}|{game}".encode()).hexdigest()[:8], 16) % prime
    d = hashlib.md5(f"{SEED}|{replicate}".encode()).hexdigest()
    u = ((int(d[:8], 16) % (prime - 1) + 1) * h + int(d[8:16], 16) % prime) % prime
    total, k = 0.0, 0
    while k < 11:  # P(Poisson(1) <= k) in parts of prime
        total += math.exp(-1) / math.factorial(k)
        if u < math.floor(prime * total):
            return k
        k += 1
    return k


def interval(rows, value):
    means = []
    for replicate in range(R):
        w = [weight(r[0], replicate) for r in rows]
        if sum(w):
            means.append(sum(x * value(r) for x, r in zip(w, rows, strict=True)) / sum(w))
    means.sort()
    n = len(means)
    return (means[max(0, math.floor(n * 0.025) - 1)], means[min(n - 1, math.floor(n * 0.975))]) if len(rows) > 1 else (None, None)


def brier(r):
    return (r[4] - r[5]) ** 2


def brute(rows):
    ok = [r for r in rows if not r[6] and r[7] is None]
    reasons = {}
    for r in rows:
        if r[6] or r[7]:
            reasons["tie" if r[6] else r[7]] = reasons.get("tie" if r[6] else r[7], 0) + 1
    bins = {}
    for r in ok:
        bins.setdefault(min(9, int(r[4] * 10 + 1e-12)), []).append(r)
    shown = [(b, len(m), sum(r[4] for r in m) / len(m), sum(r[5] for r in m) / len(m)) for b, m in sorted(bins.items())]
    return len(ok), len(rows) - len(ok), sum(map(brier, ok)) / len(ok) if ok else None, interval(ok, brier), shown, reasons


def shown(r):
    return (
        r["sample_count"], r["excluded_count"], pytest.approx(r["brier"]) if r["brier"] is not None else None,
        tuple(None if r[c] is None else pytest.approx(r[c]) for c in ("brier_low", "brier_high")),
        [(b["bin"], b["n"], pytest.approx(b["mean_predicted"]), pytest.approx(b["actual_rate"])) for b in r["reliability"]], r["exclusion_reasons"],
    )


def test_metric_sets_match_plain_python(spark):
    rows = [*samples(), (900, "c", 2020, 1, 0.5, 1, False, None), (901, "d", 2020, 1, None, 1, False, "no history")]
    sets = [["model"], ["model", "season_year"], ["week"], []]
    got = metrics.metric_sets(spark.createDataFrame(rows, SAMPLES), sets, resamples=R, seed=SEED).collect()
    names = ["model", "season_year", "week"]
    place = {"model": 1, "season_year": 2, "week": 3}
    want = {}
    for number, held in enumerate(sets):
        for r in rows:
            want.setdefault((number, *[r[place[c]] if c in held else None for c in names]), []).append(r)
    found = {(r["grouping"], *[r[c] for c in names]): r for r in got}
    assert found.keys() == want.keys() and len(got) == len(want)
    for key, group in want.items():
        assert brute(group) == shown(found[key]), key


def test_metric_sets_of_nothing(spark):
    none = spark.createDataFrame([], SAMPLES)
    assert metrics.metric_sets(none, [["model"], ["week"]], resamples=R).collect() == []
    assert metrics.metric_set(none, ["model"], resamples=R).collect() == []


def test_weights_are_poisson():
    import numpy as np

    a, c = resample.replicate_constants(500, 3)
    w = resample.poisson_weights(np.random.default_rng(1).integers(0, resample.PRIME, 2000), a, c)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert (w == 0).mean() == pytest.approx(math.exp(-1), abs=0.005)
    assert abs(np.corrcoef(w[:, :40], rowvar=False) - np.eye(40)).max() < 0.15  # replicates are unlike each other


def test_interval_covers_and_narrows(spark):
    def width(n):
        df = spark.range(n).select("id", F.lit("m").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("x"))
        low, high = resample.bootstrap_interval(df, "id", ["g"], ["x"], 400).select("x_low", "x_high").first()
        assert low < df.agg(F.avg("x")).first()[0] < high
        return high - low

    # the spread of a mean of n uniform numbers
    for n in (400, 6400):
        assert width(n) == pytest.approx(2 * 1.96 * math.sqrt(1 / 12 / n), rel=0.25)


def test_rows_and_replicates_are_never_shuffled(spark):
    df = spark.createDataFrame(samples(), SAMPLES)
    scored = metrics.with_losses(df).filter(metrics.is_scored())
    plan = resample.bootstrap_interval(scored, "game_id", ["model"], ["squared_error"], 100)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < plan.index("MapInArrow")  # only sums of a task are taken apart
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert all("LeftSemi" in line for line in joins)


def test_many_groups_are_sent_in_parts(spark, monkeypatch):
    df = spark.createDataFrame(samples(), SAMPLES)
    whole = metrics.metric_sets(df, [["game_id", "model"], ["week"]], resamples=R, seed=SEED).orderBy("grouping", "game_id", "week").collect()
    monkeypatch.setattr(resample, "_GROUPS", 5)
    monkeypatch.setattr(resample, "_ROWS", 7)
    parts = metrics.metric_sets(df, [["game_id", "model"], ["week"]], resamples=R, seed=SEED).orderBy("grouping", "game_id", "week").collect()
    assert [shown(r)[:3] for r in whole] == [shown(r)[:3] for r in parts]
    assert [(r["brier_low"], r["log_loss_high"]) for r in parts] == [(r["brier_low"] and pytest.approx(r["brier_low"]), r["log_loss_high"] and pytest.approx(r["log_loss_high"])) for r in whole]


def test_a_replicate_draws_as_many_rows_as_there_are(spark):
    rows = [("m", i, float(i * i % 17)) for i in range(40)] + [("one", 99, 1.0)]
    df = spark.createDataFrame(rows, "g string, id long, x double").repartition(3)
    places = sorted(range(40), key=lambda i: hashlib.md5(f"{K.SEED}|{i}".encode()).hexdigest())

    def draw(replicate, slot):
        return int(int(hashlib.md5(f"{K.SEED}|{replicate}|{slot}".encode()).hexdigest()[:13], 16) / 2**52 * 40)

    means = sorted(sum(places[draw(r, s)] ** 2 % 17 for s in range(40)) / 40 for r in range(100))
    found = resample.drawn_interval(df, "id", ["g"], ["x"], 100).collect()
    assert [(r["g"], round(r["x_low"], 9), round(r["x_high"], 9)) for r in found] == [("m", round(means[1], 9), round(means[97], 9))]


def test_draws_are_looked_up_in_blocks_of_rows(spark, monkeypatch):
    """No record is made for a draw, and a task holds some rows of a group only: blocks of any size give the same intervals."""
    rows = [(g, i, None if i % 7 == 3 else float(i * i % 17)) for g, n in (("m", 40), ("k", 9), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, x double").repartition(3)
    whole = resample.drawn_interval(df, "id", ["g"], ["x"], 50).orderBy("g")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "posexplode" not in plan and "explode" not in plan
    monkeypatch.setattr(resample, "HELD", 7)
    monkeypatch.setattr(resample, "_SLOTS", 11)
    parts = resample.drawn_interval(df, "id", ["g"], ["x"], 50).orderBy("g")
    assert [(r["g"], round(r["x_low"], 9), round(r["x_high"], 9)) for r in parts.collect()] == [(r["g"], round(r["x_low"], 9), round(r["x_high"], 9)) for r in whole.collect()]
