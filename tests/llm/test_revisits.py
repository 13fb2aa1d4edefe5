import random

import pytest
from pyspark.sql import functions as F

from gridcast.llm import revisits as R

SCHEMA = "record_id string, kind string, url string, captured_at long, etag string, last_modified string, headers map<string,string>, payload string"


@pytest.mark.parametrize("url,want", [
    ("HTTP://WWW.Example.com:80", "example.com/"), ("https://example.com:443/a?b=2&a=1&&#x", "example.com/a?a=1&b=2"), ("http://u:p@h.org:8080/A%20?", "h.org:8080/A%20"),
    ("no scheme", None), (None, None), ("http://", "/"), ("http://www2.x.de?z#y?w", "x.de/?z"),
])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(R.canonical_url(F.col("u")).alias("c")).first()["c"] == want


def brute(rows, canonical):
    responses = [(canonical[r[2]], r[3], r[0], r) for r in rows if r[1] == "response" and r[2] is not None and canonical[r[2]] is not None and r[3] is not None]
    out = []
    for rid, kind, url, at, etag, modified, headers, _ in rows:
        if kind != "revisit":
            continue
        key = canonical.get(url)
        if key is None or at is None:
            out.append((rid, "no_key", None, None, None))
            continue
        before = [x for x in responses if x[0] == key and x[1] < at]
        if not before:
            out.append((rid, "no_response", None, None, None))
            continue
        r = max(before, key=lambda x: (x[1], x[2]))[3]
        strip = lambda t: t[2:] if t.startswith("W/") else t
        if etag is not None and r[4] is not None:
            same = strip(etag) == strip(r[4])
        elif modified is not None and r[5] is not None:
            same = modified == r[5]
        else:
            out.append((rid, "no_validator", r[0], None, None))
            continue
        merged = {**(r[6] or {}), **{k: v for k, v in (headers or {}).items() if k in R.PERMITTED}}
        out.append((rid, "resolved", r[0], r[7], sorted(merged.items())) if same else (rid, "mismatch", r[0], None, None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["record_id"], r["outcome"], r["refers_to"], r["payload"], sorted(r["headers"].items()) if r["headers"] is not None else None) for r in df.collect()), key=repr)


def test_matches_brute_force(spark):
    draw = random.Random(9)
    pool = ["http://hot.org/", "https://www.hot.org", "http://a.de/x", "http://a.de/x#f", "http://b.de/?b&a", "http://b.de/?a&b", None, "bad"]
    canonical = {"http://hot.org/": "hot.org/", "https://www.hot.org": "hot.org/", "http://a.de/x": "a.de/x", "http://a.de/x#f": "a.de/x", "http://b.de/?b&a": "b.de/?a&b", "http://b.de/?a&b": "b.de/?a&b", "bad": None, None: None}
    rows = []
    for i in range(1500):
        kind = draw.choice(["response", "revisit", "revisit", "request"])
        headers = draw.choice([None, {}, {"date": str(i), "content-length": "9", "vary": "x"}, {"content-type": f"t{i}", "etag": "e"}])
        rows.append((f"r{i}", kind, draw.choice(pool[:2] if i % 3 else pool), draw.choice([None, *range(60)]), draw.choice([None, '"a"', 'W/"a"', '"b"']), draw.choice([None, "m1", "m2"]), headers, f"p{i}"))
    rows += [rows[0], rows[1], rows[1]]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS canonical_url", "2 AS found", "3 AS part").repartition(5)
    assert got(R.resolve_revisits(frame)) == brute(rows, canonical)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(R.resolve_revisits(frame)) == brute(rows, canonical)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert R.resolve_revisits(frame.limit(0)).count() == 0


def test_a_hot_url_is_spread(spark):
    rows = spark.range(20_000).selectExpr("concat('x', id) AS record_id", "'k' AS k", "id AS at", "CASE WHEN id % 50 = 0 THEN struct(id AS v) END AS p")
    out = R.latest_before(rows, "k", "at", "record_id", "p")
    wrong = out.where("p IS NULL AND NOT (found.v <=> 50 * cast(at / 50 AS long))").count()
    assert wrong == 0 and out.count() == 20_000


def test_only_the_schemes_own_port_is_dropped(spark):
    urls = ["http://h:80/x", "https://h:443/x", "HTTP://h/x", "https://h:/x", "http://h:443/x", "https://h:80/x", "ftp://h:80/x", "http://h:8080/x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(R.canonical_url(F.col("u")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["h/x"] * 4 + ["h:443/x", "h:80/x", "h:80/x", "h:8080/x"]
