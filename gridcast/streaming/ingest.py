"""The landing jobs as continuous ones: the same transformations over a stream of snapshot files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gridcast.session import drop, stage
from gridcast.sources.landed import scoreboard_games, verify_envelopes

ENVELOPE = "normalization_version string, source_url string, retrieved_at string, payload_sha256 string, payload string"


def landed_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Snapshot envelopes (one JSON object per line) as they land."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def once(envelopes: DataFrame, version: str) -> DataFrame:
    """Verified envelopes, each snapshot (payload and source) once, whenever it lands again; rejected ones once if they are wholly alike.

    On a stream the seen snapshots are keyed state that survives a restart; a batch costs a lookup for each of its own
    envelopes, however many were accepted before. There is no watermark, as backfills land at any time,
    so the state holds one digest for each snapshot ever seen, on disk (see ``keyed_state``).
    """
    checked = verify_envelopes(envelopes, version).withColumnRenamed("problem", "envelope_problem")
    known = F.when(F.col("envelope_problem").isNull(), F.struct("payload_sha256", "source_url"))
    whole = F.when(F.col("envelope_problem").isNotNull(), F.struct(*envelopes.columns))
    identity = F.sha2(F.to_json(F.struct(known.alias("known"), whole.alias("whole"))), 256)
    return checked.withColumn("identity", identity).dropDuplicates(["identity"]).drop("identity")


def game_rows(envelopes: DataFrame, version: str) -> DataFrame:
    """Game rows of all envelopes, each snapshot once. A rejected envelope is one row with its problem; no row is dropped, however late it lands."""
    checked = once(envelopes, version)
    readable = checked.withColumn("payload", F.when(F.col("envelope_problem").isNull(), F.col("payload")))
    rows = scoreboard_games(readable)
    return rows.withColumn("problem", F.coalesce("envelope_problem", "problem")).drop("envelope_problem")


def keyed_state(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, on the executors' disks with change logs in the checkpoint, instead of on their heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def write_games(rows: DataFrame, accepted: str, quarantine: str, checkpoint: str) -> DataStreamWriter:
    """Sink that splits every batch into accepted games and quarantine.

    Repeated snapshots do not come this far (see ``once``). Each batch goes to its own folder and overwrites it, so a batch
    that is run again after a lost driver does not double its rows.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch = stage(batch)
        good = batch.filter("problem IS NULL").drop("problem").dropDuplicates(["payload_sha256", "source_url", "event_id"])
        good.write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        batch.filter("problem IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        drop(batch)

    keyed_state(rows.sparkSession)
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
