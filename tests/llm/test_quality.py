import random
import zlib

import numpy as np
import pytest

from gridcast.llm import quality


def make(n):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(20, 200))]
        good = draw.random() < 0.8
        text = " ".join(words).capitalize() + "."
        if not good:
            text = draw.choice([" ".join(w + "###" for w in words), " ".join(words).upper().replace(" ", "!! "), " ".join([words[0]] * len(words))])
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def frames(spark, n=600):
    rows, labels = make(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_order(spark):
    rows, labels, docs, known = frames(spark)
    found = {r["doc_id"]: r for r in quality.score_documents(docs, known).collect()}
    assert len(found) == len(rows)
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(found[i]["score"], y) for i, y in labels if found[i]["held_out"]]
    assert np.mean([(s >= 0.5) == y for s, y in held]) >= 0.97
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_held_out_labels_are_not_learned(spark):
    rows, labels, docs, known = frames(spark, 300)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    other = quality.learn(docs, spark.createDataFrame(turned, "doc_id long, quality int"))
    assert np.array_equal(quality.learn(docs, known).weights, other.weights)


def test_sample_is_bounded_and_rerun_agrees(spark):
    _, _, docs, known = frames(spark)
    a, b = quality.learn(docs, known, sample=100), quality.learn(docs.repartition(9), known, sample=100)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_fit_is_the_minimum_of_the_pair_loss():
    draw = np.random.default_rng(1)
    better, worse = draw.normal(0.4, 1, (500, 3)), draw.normal(0, 1, (500, 3))
    w = quality.fit_pairs(better, worse)

    def loss(v):
        return np.log1p(np.exp(-(better - worse) @ v)).mean() + quality.RIDGE / 2 * v @ v

    assert all(loss(w) <= loss(w + d) for d in 1e-3 * draw.normal(size=(50, 3)))


def test_threshold_splits_at_a_quantile():
    x = np.zeros((100, len(quality._NAMES)))
    x[:, 0] = np.arange(100)
    y = (x[:, 0] >= 30).astype(int)
    model = quality.fit_ranking(x, y)
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() >= 0.99


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (5, None), (None, 1)]])
def test_odd_input(spark, odd_docs, no_docs, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality.score_documents(odd_docs, known).collect()
    assert len(found) == odd_docs.count() and all(r["score"] == 0.5 for r in found)
    assert not any(r["held_out"] for r in found if r["doc_id"] is None)
    assert quality.score_documents(no_docs, known).count() == 0
    assert quality.accept(odd_docs, known).columns == odd_docs.columns


def test_texts_without_words_share_a_score(spark, odd_docs):
    _, _, docs, known = frames(spark, 300)
    more = known.union(spark.createDataFrame([(3, 0), (9, 1), (9, 0)], "doc_id long, quality int"))
    found = quality.score_documents(odd_docs.select("doc_id", "text").union(docs), more).collect()
    blank = {r["score"] for r, t in zip(found, odd_docs.select("text").collect()) if t["text"] is None or not t["text"].strip(" \t\n")}
    assert len(blank) == 1


def test_every_label_counts(spark):
    """25,000 labelled rows, of which one group is bad: a fit on a sample of 20,000 has other moments."""
    docs = spark.range(0, 40000, 1, 4).selectExpr("id AS doc_id", "concat(repeat('a ', cast(id % 7 + 1 AS int)), 'w', id) AS text")
    known = docs.selectExpr("doc_id", "cast(doc_id % 7 > 2 AS int) AS quality")
    model = quality.learn(docs, known)
    x = np.array([quality.features(f"{'a ' * (i % 7 + 1)}w{i}") for i in range(40000) if zlib.crc32(str(i).encode()) % 3 != 1])
    assert len(x) > 25000
    assert np.allclose(model.mean, x.mean(axis=0), rtol=1e-12, atol=1e-12)
    assert np.allclose(model.scale[0], x.std(axis=0)[0], rtol=1e-9)
    found = quality.score_documents(docs, known).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 7 > 2) for r in found)


def test_a_rare_label_meets_every_block(spark):
    docs = spark.range(0, 9000, 1, 4).selectExpr(
        "id AS doc_id", "if(id % 1500 = 0, repeat('### ', 30), concat('word', id, ' and more')) AS text")
    known = docs.selectExpr("doc_id", "cast(doc_id % 1500 != 0 AS int) AS quality")
    model = quality.learn(docs, known)
    bad, good = model.score(np.array([quality.features("### " * 30), quality.features("word7 and more")]))
    assert bad < good - 0.3
