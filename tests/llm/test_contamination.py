import re
from collections import defaultdict

import pytest

from gridcast.llm import contamination as C


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words, hit, names = norm(text), set(), set()
        for name, item in items:
            own = norm(item)
            n = min(window, len(own))
            for i in range(len(own) - n + 1 if own else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == own[i : i + n]:
                        hit.update(range(j, j + n))
                        names.add("" if name is None else str(name))
        out.append((repr(doc_id), len(words), len(hit), tuple(sorted(names)), bool(hit)))
    return sorted(out)


def got(df):
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in df.collect())


ITEM = "The quick brown fox jumps over the lazy dog and then it sleeps, öfter als 3 times a day."
ITEMS = [(1, ITEM), (2, "tiny Item"), (3, None), (4, " ,;"), (None, "null id passage is seven words long"), (11, ITEM.upper().replace("Ö", "ö")), (2, "tiny Item")]


def test_matches_brute_force(spark):
    words = norm(ITEM)
    docs = [(1, ITEM), (2, "before " + " ".join(words[2:12]) + " after"), (3, " ".join(words[2:11])), (4, "a tiny-item! tiny item"), (5, None), (6, "null id passage is seven words long; null id"), (7, " ".join(words * 3)), (8, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(C.contaminated_documents(frame, items)) == brute(docs, ITEMS)
    # a benchmark larger than one slice gives the same
    assert got(C.contaminated_documents(frame, items, slice_bytes=40)) == brute(docs, ITEMS)


def test_random_texts(spark):
    import random

    draw = random.Random(3)
    text = lambda n: " ".join(draw.choice("abc") for _ in range(n))
    items = [(i, text(draw.randint(1, 9))) for i in range(20)]
    docs = [(i, text(draw.randint(0, 40))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(C.contaminated_documents(frame, spark.createDataFrame(items, "item_id long, text string"), window=4)) == brute(docs, items, 4)


def test_removal(spark):
    words = norm(ITEM)
    docs = [(1, "Keep this. " + ITEM + " And this."), (2, "clean"), (3, None), (4, " ".join(words[3:15]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in C.decontaminate(frame, items).collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in C.decontaminate(frame, items, drop=False).collect()}
    assert cut == {1: "Keep this. . And this.", 2: "clean", 3: None, 4: ""}


def test_odd_input(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    short = [(d, t) for d, t in rows if t is None or len(t) < 1000]
    found = got(C.contaminated_documents(odd_docs, items))
    assert len(found) == len(rows)
    assert [f for f in found if f[1] < 1000 and f[1] != 1] == [f for f in brute(short, ITEMS) if f[1] != 1]
    assert C.contaminated_documents(no_docs, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r[4] for r in got(C.contaminated_documents(odd_docs, none)))
    assert C.decontaminate(odd_docs, items).columns == odd_docs.columns


def test_index_is_exact_under_equal_hash_salts():
    index = C.WindowIndex([("a", "x y"), ("b", "y x")], window=2)
    assert index.find("x y x") == (3, [[0, 3]], ["a", "b"])
