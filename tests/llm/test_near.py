import random
import re
from collections import defaultdict

import numpy as np
import pytest

from gridcast.llm import near
from gridcast.llm.components import components


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows):
    """doc_id -> (n shingles, least id of the component), for distinct ids."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    pairs = defaultdict(int)
    for members in by_shingle.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                pairs[a, b] += 1
    for (a, b), both in pairs.items():
        if 100 * both >= 75 * (len(sets[a][1]) + len(sets[b][1]) - both):
            x, y = find(sets[a][0]), find(sets[b][0])
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def make(seed, groups=25, alone=60):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(draw.choice([1, 3, 5, 20, 120]))) for _ in range(alone)]
    for _ in range(groups):
        base = [word() for _ in range(draw.choice([30, 90, 200]))]
        for _ in range(draw.choice([2, 3, 12])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = make(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(near.near_duplicates(docs)) == brute(rows)


def test_links_that_no_hub_sees(spark):
    """A chain: each text is similar to its neighbours only, so links run between members that share no hub."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[i * 8 : i * 8 + 150])) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(near.near_duplicates(docs)) == want and len({c for _, c in want.values()}) == 1


def test_large_group_and_case_and_blanks(spark):
    base = [f"word{i}" for i in range(60)]
    rows = [(i, ("\t" if i % 2 else " ").join(base).upper() if i % 3 else " ".join(base)) for i in range(300)]
    rows += [(1000 + i, " ".join([*base[:30], f"x{i}", *base[31:]])) for i in range(200)]
    found = got(near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    want = brute(rows)
    assert found == want


@pytest.mark.parametrize("bounds", [{}, {"PROBED": 300, "BLOCKS": 2, "STREAMED": 20}])
def test_blocks_of_a_crowded_bucket(spark, monkeypatch, bounds):
    """Clusters that share most shingles, but are not all similar, meet in the same buckets; small blocks find the same links."""
    for name, value in bounds.items():
        monkeypatch.setattr(near, name, value)
    base, draw = [f"word{i}" for i in range(120)], random.Random(4)
    rows = []
    for i in range(70):
        copy = list(base)
        for place in draw.sample(range(120), draw.choice([1, 2, 3, 4])):
            copy[place] = f"x{draw.randrange(3)}"
        rows.append((i, " ".join(copy)))
    found = got(near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)))
    assert found == brute(rows)


def test_odd_input(spark, odd_docs, no_docs):
    found = near.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert by_id[1] == {(3, 1, True), (5, 1, True)}
    assert by_id[None] == {(3, 1, False), (0, None, True)}
    assert by_id[2] == {(0, 2, True)} and by_id[3] == {(0, 3, True)} and by_id[9] == {(1, 9, True)}
    assert {c for _, c, _ in by_id[6]} == {5}
    assert near.near_duplicates(no_docs).count() == 0
    kept = near.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(repr(r["doc_id"]) for r in kept.select("doc_id").collect())
    # of three rows in one component one stays; the other text under id 1, the texts without words and the rest stay
    assert ids == sorted(map(repr, [1, 1, None, 2, 3, 4, 5, 7, 8, 9]))
    assert near.one_of_each(no_docs).count() == 0


def test_estimate_follows_the_similarity():
    draw = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.75, 0.95):
        errors = []
        for _ in range(30):
            both = int(2000 * share / (2 - share) * 2 / 2 * 1)
            common = draw.integers(0, 1 << 63, both, dtype=np.uint64)
            n = int(both / share)
            a = np.concatenate([common, draw.integers(0, 1 << 63, (n - both) // 2, dtype=np.uint64)])
            b = np.concatenate([common, draw.integers(0, 1 << 63, (n - both) // 2, dtype=np.uint64)])
            x, y = (near.planes(near.minima(np.unique(s))).view(np.uint64) for s in (a, b))
            differs = np.zeros(2, dtype=np.uint64)
            for plane in range(near.BITS):
                differs |= x[2 * plane : 2 * plane + 2] ^ y[2 * plane : 2 * plane + 2]
            matches = near.MINIMA - sum(int(d).bit_count() for d in differs)
            errors.append((matches / near.MINIMA - 1 / 16) / (15 / 16) - share)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000)) + " " + "q" * 9000 + " tail"
    whole = near.shingles(text)
    assert len(whole) == 5002 - 4
    monkeypatch.setattr(near, "_BLOCK", 4096)
    small = near.shingles(text)
    assert len(np.intersect1d(whole, small)) >= len(whole) - 5  # all but those with the word longer than a block


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (202, 200), (5, 5)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in [*range(41), 100]} | {i: 200 for i in (200, 201, 202)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_leave_by_place_without_a_shuffle_of_the_others(spark, tmp_path):
    docs = spark.range(0, 1000, 1, 3).selectExpr("id AS doc_id", "concat('text ', id) AS text", "id AS masked", "id AS row_key")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    keyed = near.with_row_key(docs, "place")
    out = lambda ids: near.without_rows(docs, keyed.where(ids).select("place.file", "place.row"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for ids in ("doc_id % 64 = 63 OR doc_id % 7 = 0", "doc_id < 0", "doc_id >= 0"):
            found = out(ids)
            assert found.columns == docs.columns
            assert sorted(found.collect()) == sorted(docs.where(f"NOT ({ids})").collect())
        rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(30))) for i in range(200)]
        whole = near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
        assert "SortMergeJoin" not in whole._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
        assert sorted(r["doc_id"] for r in whole.collect()) == list(range(0, 200, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
