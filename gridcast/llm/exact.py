"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import BLANKS, free_name, on_files, with_row_key
from gridcast.session import stage

#: A digest held by more than one row in HEAVY is frequent. At most 2 * HEAVY digests are ever collected and broadcast.
HEAVY = 4096


def misra_gries(counts: pd.Series, counters: int) -> pd.Series:
    """Keep at most ``counters`` of the counts: subtract the next largest from all, drop what is left without."""
    if len(counts) <= counters:
        return counts
    cut = counts.nlargest(counters + 1).iloc[-1]
    counts = counts - cut
    return counts[counts > 0]


def frequent_digests(rows: DataFrame, heavy: int) -> list[bytes]:
    """The digests that may be held by more than 1 / ``heavy`` of all rows; no such digest is missed.

    Each task keeps 2 * ``heavy`` Misra-Gries counters, so a sum of counters lies below the true count
    by at most 1 / (2 * heavy) of the rows, and at most 2 * ``heavy`` digests can reach the bound.
    """
    total = rows.count()
    counters = 2 * heavy

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.Series(dtype="int64")
        for batch in batches:
            kept = misra_gries(kept.add(batch["digest"].value_counts(), fill_value=0).astype("int64"), counters)
        yield pd.DataFrame({"digest": kept.index.astype(object), "n": kept.to_numpy()})

    summaries = rows.select("digest").mapInPandas(summarise, "digest binary, n long")
    least = max(1.0, total / heavy - total / (counters + 1))
    found = summaries.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return [bytes(r["digest"]) for r in found.select("digest").collect()]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after deleting white space. Of equal texts, the row with the most code
    points stays, then the one with the smallest id (a null id comes last), then, of repeated rows, one by its place
    in the files. A null text counts as empty, and all empty texts are equal. A text of any length is hashed whole.
    Other columns of ``docs``, whatever their names, are not read. An empty table gives none.

    Digests and lengths are written once. Misra-Gries summaries find the frequent digests; these
    are counted exactly, with one row per task and digest shuffled, and their winners are broadcast (at most
    2 * ``heavy`` rows), so their rows leave without a shuffle. No other digest has more than
    1 / ``heavy`` of the rows; those meet in an ordinary shuffle of digests.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = on_files(docs)
    place = free_name(docs, "place")
    rows = stage(
        with_row_key(docs, place).select(
            F.col(place).alias("place"),
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256)).alias("digest"),
            F.char_length(text).alias("length"),
        )
    )
    rank = F.struct((-F.col("length")).alias("short"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("place").alias("place"))
    found = [(bytearray(d),) for d in frequent_digests(rows, heavy)]
    candidates = F.broadcast(spark.createDataFrame(found, "digest binary"))
    counted = rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))
    winners = F.broadcast(stage(counted.where(F.col("group_size") > rows.count() / heavy)))
    hot = rows.join(winners, "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(winners, "digest", "left_anti").select("*", F.count(F.lit(1)).over(same).alias("group_size"), F.min(rank).over(same).alias("best"))
    kept = F.col("place") == F.col("best.place")
    return hot.unionByName(rest).select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


