"""Registered queries against their SQL, or a brute-force version, on the smallest tables; and the pipeline stage by stage."""

import os
import zlib
from collections import Counter

import corpus_pipeline
import oracle
import pytest
from pyspark.sql import functions as F

import test_near
import test_pii
from gridcast.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, con, name):
    ok, message = oracle.compare(queries.QUERIES[name](spark, FOLDER), con, queries.SQL[name])
    assert ok, message


def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def test_near_duplicates(spark):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op5_near_duplicates(spark, FOLDER).collect()}
    assert found == test_near.brute(texts(spark))


def test_personal_data(spark):
    rows = queries.op8_personal_data(spark, FOLDER).collect()
    want = {d: test_pii.base(t) for d, t in texts(spark)}
    for r in rows:
        spans = [s for s in want[r["doc_id"]].split(",") if s]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k) for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(spans) <= set(r["spans"].split(","))
    assert len(rows) == len(want)


def test_reshard(spark):
    rows = queries.op1_reshard(spark, FOLDER).collect()
    want = sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts(spark))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_quality(spark, con):
    found = queries.op3_quality(spark, FOLDER).toPandas()
    labels = con.execute("SELECT doc_id, quality FROM labels").df()
    held = found.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held.quality).mean() >= 0.95


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, apply in corpus_pipeline.STAGES:
        out = apply(spark, docs, FOLDER).cache()
        kept[name] = (docs, out)
        if name != "sharding":
            assert out.columns == columns
            docs = out
    before, after = kept["quality"]
    scores = {r["doc_id"]: r["predicted"] for r in queries.op3_quality(spark, FOLDER).collect()}
    assert {r["doc_id"] for r in after.collect()} == {d for d, p in scores.items() if p}
    before, after = kept["near_duplicates"]
    want = test_near.brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {d for d, (_, c) in want.items() if d == c}
    before, after = kept["decontamination"]
    hit = {r["doc_id"]: r["contaminated"] for r in queries.op7_decontaminate(spark, FOLDER).collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if not hit[r["doc_id"]]}
    before, after = kept["mixing"]
    assert set(Counter(r["doc_id"] for r in after.collect()).values()) <= {1, 2}
    before, after = kept["sharding"]
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(r["doc_id"] for r in before.collect())


def test_pipeline_handles_odd_tables(spark, odd_docs, no_docs, tmp_path):
    for i, docs in enumerate((odd_docs, no_docs)):
        docs.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{i}/labels.parquet")
        spark.createDataFrame([(1, "never seen passage"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{i}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{i}")
        assert out.count() >= 0 and "shard" in out.columns


def test_whole_run_repeats(spark):
    a, b = (corpus_pipeline.run(spark, FOLDER).agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "shard", "slot").cast("decimal(38,0)"))).first() for _ in range(2))
    assert a == b
