import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gridcast.llm import common, mixing


def fill(sizes, weights, total):
    """Share the total by weight; cap at twice the size; share the excess again until none is above."""
    target, open_ = {}, set(sizes)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        target |= {s: Fraction(2 * sizes[s]) for s in above}
        open_ -= above
    return target


def brute(rows):
    size = {i: len((t or "").split()) for i, (_, t, _) in enumerate(rows)}
    sizes = defaultdict(int)
    for i, (_, _, s) in enumerate(rows):
        sizes[s] += size[i]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    targets = fill(sizes, weights, Fraction(3 * sum(size.values()), 2))
    taken = {}
    for s in order:
        own = [i for i, r in enumerate(rows) if r[2] == s]
        digest = lambda text: hashlib.md5((text or "").encode()).hexdigest()
        h = {i: int(digest(f"mix|{'null' if rows[i][0] is None else rows[i][0]}|{digest(rows[i][1])}")[:11], 16) for i in own}
        whole = min(2, int(targets[s] / sizes[s])) if sizes[s] else 0
        budget, before = targets[s] - whole * sizes[s], 0
        for i in sorted(own, key=h.get):
            taken[i] = size[i] * (whole + (2 * before + size[i] < 2 * budget))
            before += size[i]
    return sorted((rows[i][0], size[i], sizes[rows[i][2]], round(float(targets[rows[i][2]]), 6), taken[i]) for i in taken if rows[i][0] is not None), sizes, targets


def got(df):
    return sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect() if r["doc_id"] is not None)


def test_matches_brute_force_and_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "hot" if i % 3 == 0 else [None, "b", "c", "ü", "z"][i % 5]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want, sizes, targets = brute(rows)
    found = mixing.mix(docs)
    assert got(found) == want
    by_source = found.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"))
    assert all(abs(r["t"] - targets[r["source"]]) <= 25 for r in by_source.collect())
    assert got(mixing.mix(docs.repartition(3))) == want


def test_mixed_documents_repeats_rows(spark):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in times.items() if v}


def test_repeated_rows_and_ids_are_taken_one_by_one(spark):
    """A third of the ids null, and a source of copies of one row: targets are met within a document all the same."""
    rows = [(None if i % 3 == 0 else i, "w " * (1 + i % 40), "ab"[i % 2]) for i in range(1500)] + [(7, "same text here", "copies")] * 3000 + [(None, "w", "nobody")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    _, _, targets = brute(rows)
    counts = mixing.mixed_documents(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("t")).collect()
    assert {r["source"] for r in counts} == set(targets)
    assert all(abs(r["t"] - targets[r["source"]]) <= 40 for r in counts)
    assert sum(r["taken"] for r in mixing.mix(docs).collect()) == sum(r["t"] for r in counts)


def test_names_of_its_own_columns_may_be_taken(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    named = docs.select("*", *[F.lit(c).alias(c) for c in ("mix_k", "mix_full", "mix_cut", "mix_copy", "place", "k", "__mix_copy")])
    out = mixing.mixed_documents(named)
    assert out.columns == named.columns and out.count() == mixing.mixed_documents(docs).count()
    assert {(r["mix_k"], r["mix_copy"], r["place"]) for r in out.collect()} == {("mix_k", "mix_copy", "place")}


def test_runs_without_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for found in (mixing.mix(docs), mixing.mixed_documents(docs)):
        assert not any(w in found._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))


def test_odd_input(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.select("doc_id", "text", "source").collect()]
    found = mixing.mix(odd_docs)
    assert got(found) == brute(rows)[0] and found.count() == len(rows)
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns and mixing.mixed_documents(odd_docs).count() > 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


@pytest.mark.parametrize("budget", [-1.0, 0.0, 10.0, 10.6, 250.5, 1e9])
def test_cuts_are_the_nearest_prefix(spark, budget):
    items = [("k", (i * 2654435761) % (1 << 60) if i % 7 else 12345, 1 + i % 13) for i in range(500)]
    cut = common.hash_cuts(spark.createDataFrame(items, "k string, h long, size long"), spark.createDataFrame([("k", 0, budget)], "k string, no int, budget double")).first()["cut"]
    got = sum(s for _, h, s in items if h < cut)
    prefixes = [0] + [sum(s for _, h, s in items if h <= x) for x in {h for _, h, _ in items}]
    best = min(prefixes, key=lambda p: (abs(p - max(0, budget)), p))
    assert got == best
