import hashlib
import re
from collections import defaultdict

import pandas as pd
import pytest

from gridcast.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        text = text or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((doc_id, len(text)))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        digest = hashlib.sha256(norm.encode()).hexdigest()
        first = members.index(best)
        out += [(d, best[0], len(members), i == first, digest) for i, (d, n) in enumerate(members)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("heavy", [2, 8, 4096])
def test_matches_brute_force_on_both_paths(spark, heavy):
    rows = [(i, "copy  me" if i % 3 == 0 else f"text {i % 40}" + " " * (i % 5)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(exact.exact_duplicates(docs, heavy=heavy)) == brute(rows)


@pytest.mark.parametrize("heavy", [1, 4096])
def test_one_of_repeated_rows_stays(spark, heavy):
    rows = [(1, "same"), (1, "same"), (2, "same"), (None, "x y"), (None, "x y"), (None, "xy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = rows_of(exact.exact_duplicates(docs, heavy=heavy))
    assert found == brute(rows) and sum(r[3] for r in found) == 2


def test_odd_input(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert rows_of(exact.exact_duplicates(odd_docs)) == brute(rows)
    assert exact.exact_duplicates(no_docs).count() == 0


def test_frequent_digests_are_never_missed(spark):
    rows = spark.createDataFrame([(b"hot",) if i % 4 == 0 else (str(i).encode(),) for i in range(4000)], "digest binary").repartition(16)
    found = exact.frequent_digests(rows, heavy=8)
    assert b"hot" in found and len(found) <= 16


def test_counters_undercount_by_a_bounded_error():
    counts = pd.Series({"a": 50, **{f"x{i}": 1 for i in range(30)}})
    kept = exact.misra_gries(counts, 5)
    assert len(kept) <= 5 and 50 - 80 / 6 <= kept["a"] <= 50
