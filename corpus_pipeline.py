"""The corpus pipeline: documents in, a filtered, deduplicated, decontaminated, mixed and sharded corpus out.

Each stage gets the rows the one before it wrote, as ``docs``, and its decision takes effect: what it rejects is gone for all
later stages. All but the last return the columns of ``docs`` as they are, whatever these are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridcast.llm import contamination, mixing, near, quality, sharding
from gridcast.llm.common import table
from gridcast.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ranking score reaches the threshold learned from ``labels``.

    Null, empty and blank texts have one score, that of a text without features. Repeated rows are decided alike.
    """
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: the one with the smallest id; of repeated rows, one.

    Texts without words are similar to nothing and stay.
    """
    return near.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs. Texts without words stay."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target of their source asks for: not at all, once or twice. Texts without words go with their hash like the others."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard and slot of every row: 24 shards of nearly equal bytes."""
    return sharding.reshard(docs)


#: In the order in which they run.
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed_sources),
    ("sharding", sharded),
]

#: The ranking and the signatures are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
