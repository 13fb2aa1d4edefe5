import re

import numpy as np
import pytest

from gridcast.llm import urls


def brute(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


URLS = [
    "http://a.net/", "http://net/x", "https://example.net/en/1", "https://EXAMPLE.net/en", "ftp://x.example.net/en/?q", "http://notexample.net/en/", "http://example.com/de/", "http://sub.example.com/de/x#f",
    "http://example.com/DE/", "http://a.org/fr/", "http://org/fr/x", "http://org?x=/fr/", "http://a.net?x", "http://a.net", None, "", "no scheme net/", "http://", "http:///net/", "http://net./", "http://.net/",
    "x://y://z.net/", "http://a.b.c.d.e.f.net/p", "http://ünï.net/ä", "http://" + "a." * 30_000 + "net/", "http://net/" + "p" * 50_000, "http://a\n.net/\n",
]


@pytest.mark.parametrize("rules", [urls.RULES, (), (("net", "", "block"), ("a.net", "/", "allow"), ("b.c.d.e.f.net", "/p", "deny"))])
def test_matches_brute_force(spark, rules):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS keys", "1 AS lists").repartition(3)
    found = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules).collect()), key=repr)
    assert found == sorted(((i, *brute(u, rules)) for i, u in rows), key=repr)
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    draw = np.random.default_rng(0)
    keys = draw.integers(-(1 << 63), (1 << 63) - 1, (20_000, 2))
    listed, universe = keys[:3000], keys[500:]
    frame = lambda rows: spark.createDataFrame([(int(a), int(b)) for a, b in rows], "h1 long, h2 long")
    cascade = urls.build_cascade(frame(np.concatenate([listed, listed[:10]])), frame(np.concatenate([universe, universe[:100]])))
    found = cascade.listed(keys[:, 0].copy().view(np.uint64), keys[:, 1].copy().view(np.uint64))
    assert len(cascade.levels) > 1 and found.tolist() == [i < 3000 for i in range(20_000)]
    bits = sum(level.size for level in cascade.levels)
    assert bits < 3000 * 20
    assert not urls.build_cascade(frame([]), frame(universe)).listed(np.arange(3, dtype=np.uint64), np.arange(3, dtype=np.uint64)).any()
