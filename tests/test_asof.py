"""The as-of core against brute force on small random tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridcast.operators.asof import asof_aggregate, best_of_intervals, timeline
from gridcast.operators.availability import corroborated_at

START = datetime(2020, 1, 1)


def moments(rng, n, days=60):
    """Times on a coarse grid, so equal times and empty buckets both occur."""
    return [START + timedelta(hours=6 * rng.randrange(days * 4)) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    facts = [(rng.choice("aaaabc"), t, rng.randrange(100)) for t in moments(rng, 400)]
    probes = [(rng.choice("abcd"), t) for t in moments(rng, 150)]
    return (
        facts, probes,
        spark.createDataFrame(facts, "k string, ts timestamp_ntz, v long"),
        spark.createDataFrame(probes, "k string, at timestamp_ntz"),
    )


MEASURES = lambda: {
    "n": ("sum", F.lit(1)), "total": ("sum", F.col("v")), "least": ("min", F.col("v")), "most": ("max", F.col("v")),
    "bits": ("or", F.col("v")),
}


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("bucket", [1, 7, 365])
def test_asof_matches_brute_force(tables, inclusive, bucket):
    facts, probes, f, p = tables
    got = asof_aggregate(p, f, ["k"], "ts", MEASURES(), probe_ts="at", inclusive=inclusive, bucket_days=bucket).collect()
    assert len(got) == len(set(probes))
    for r in got:
        seen = [v for k, t, v in facts if k == r["k"] and (t < r["at"] or (inclusive and t == r["at"]))]
        bits = 0
        for v in seen:
            bits |= v
        assert (r["n"], r["total"], r["least"], r["most"], r["bits"]) == (
            len(seen), sum(seen), min(seen, default=None), max(seen, default=None), bits,
        )


def test_later_facts_change_nothing_earlier(tables, spark):
    facts, probes, f, p = tables
    cut = START + timedelta(days=30)
    early = p.filter(F.col("at") <= F.lit(cut).cast("timestamp_ntz"))
    more = f.unionByName(spark.createDataFrame([("a", cut, 999), ("b", cut + timedelta(days=1), 999)], f.schema))
    rows = lambda facts: sorted(map(tuple, asof_aggregate(early, facts, ["k"], "ts", MEASURES(), probe_ts="at").collect()), key=str)
    assert rows(f) == rows(more)


@pytest.mark.parametrize("bucket", [1, 7, 365])
def test_timeline_matches_brute_force(tables, bucket):
    facts, _, f, _ = tables
    got = timeline(f.withColumn("place", F.unix_date(F.col("ts").cast("date"))), ["k"], "ts", MEASURES(), lead="place", bucket_days=bucket).collect()
    times = {}
    for k, t, _v in facts:
        times.setdefault(k, set()).add(t)
    assert len(got) == sum(map(len, times.values()))
    for r in got:
        upto = [v for k, t, v in facts if k == r["k"] and t <= r["ts"]]
        before = [v for k, t, v in facts if k == r["k"] and t < r["ts"]]
        later = sorted(t for t in times[r["k"]] if t > r["ts"])
        assert r["n"] == len(upto) and r["before_n"] == len(before)
        assert r["most"] == max(upto) and r["before_most"] == max(before, default=None)
        assert r["valid_to"] == (later[0] if later else None)
        assert r["next_place"] == ((later[0].date() - datetime(1970, 1, 1).date()).days if later else None)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 100])
def test_best_of_intervals_matches_brute_force(spark, size):
    rng = random.Random(size)
    intervals = []
    for i in range(300):
        lo, hi = sorted((rng.randrange(size + 1), rng.randrange(size + 1)))
        intervals.append((rng.choice("xy"), rng.choice("gh"), i, rng.randrange(20), lo, hi))
    probes = [(a, i, size) for a in "xyz" for i in range(size)]
    got = best_of_intervals(
        spark.createDataFrame(probes, "axis string, position long, axis_size long"),
        spark.createDataFrame(intervals, "axis string, grp string, id long, score long, lo long, hi long"),
        ["axis"], ["grp"], [F.col("score").desc(), F.col("id")], 2, ["id", "score"],
    ).collect()
    found = {(r["axis"], r["position"], r["grp"], r["place"]): r["id"] for r in got}
    want = {}
    for axis, position, _ in probes:
        for g in "gh":
            active = sorted((-s, i) for a, gg, i, s, lo, hi in intervals if a == axis and gg == g and lo <= position < hi)
            for place, (_, i) in enumerate(active[:2], 1):
                want[(axis, position, g, place)] = i
    assert found == want


@pytest.mark.parametrize("sources", [1, 2, 3, 8])
def test_corroboration_matches_brute_force(spark, sources):
    rng = random.Random(sources)
    rows = []
    for i in range(400):
        at = START + timedelta(minutes=10 * rng.randrange(600))
        rows.append((rng.choice("pq"), i, f"s{rng.randrange(sources)}", at, at + timedelta(minutes=rng.choice([0, 0, 30, 600]))))
    df = spark.createDataFrame(rows, "k string, report_id long, source string, event_time timestamp_ntz, visible_at timestamp_ntz")
    found = {r["report_id"]: r["corroborated_at"] for r in corroborated_at(df, ["k"]).collect()}
    want = {}
    for k, i, s, at, vis in rows:
        partners = [v for kk, _, ss, aa, v in rows if kk == k and ss != s and abs(aa - at) <= timedelta(hours=2)]
        if partners:
            want[i] = max(vis, min(partners))
    assert found == want


@pytest.mark.parametrize("sparse", [1000, 150, 0])
def test_sparse_keys_are_put_in_order_whole(tables, sparse):
    """All keys whole, the crowded one through buckets, or all of them: the same steps. Keys with few facts take one shuffle."""
    _, _, f, _ = tables
    f = f.withColumn("place", F.unix_date(F.col("ts").cast("date")))
    shown = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    got = timeline(f, ["k"], "ts", MEASURES(), lead="place", sparse=sparse)
    assert shown(got) == shown(timeline(f, ["k"], "ts", MEASURES(), lead="place"))
    if sparse == 1000:
        assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
