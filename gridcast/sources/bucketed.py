"""A stored table that a batch changes in part: key-hash buckets, and a manifest of their folders for each version.

``<root>/data/<batch>/bucket=<n>`` holds the rows of one bucket as one batch left it, and is never written again.
``<root>/manifest/version=<v>`` names one folder for every bucket that has rows. A batch reads and rewrites the buckets its keys fall into;
the next manifest names the new folders for these and the old ones for all others. The manifest is written last, so readers see a version as a
whole or not at all, a writer that dies leaves folders nobody names, and of two writers of one version the second fails.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.session import drop, path_exists, stage

#: Buckets of a new table. Its manifest, as long as this, is all that passes through the driver.
BUCKETS = 256
MANIFEST = "version long, buckets int, bucket int, folder string"


@dataclass(frozen=True)
class Version:
    number: int
    buckets: int
    folders: dict[int, str]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_version(spark: SparkSession, root: str, version: int | None = None) -> Version | None:
    """The manifest of ``version``, or of the last one; None for a table never written."""
    where = f"{root}/manifest"
    if not path_exists(spark, where):
        return None
    rows = spark.read.schema(MANIFEST).parquet(where)
    wanted = rows.agg(F.max("version")).first()[0] if version is None else version
    found = rows.where(F.col("version") == F.lit(wanted)).collect()
    if not found:
        if version is None:
            return None
        raise ValueError(f"{root} has no version {version}")
    return Version(wanted, found[0]["buckets"], {r["bucket"]: r["folder"] for r in found if r["bucket"] is not None})


def _rows(spark: SparkSession, schema: T.StructType, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The rows of a version (the last one, if none is named); none for a table never written."""
    found = read_version(spark, root, version)
    return _rows(spark, schema, sorted(found.folders.values()) if found else [])


def read_keys(spark: SparkSession, root: str, schema: T.StructType, asked: DataFrame, key: str = "id", version: int | None = None) -> DataFrame:
    """The rows whose key is in ``asked``. Only the buckets of these keys are read."""
    found = read_version(spark, root, version)
    if not found:
        return spark.createDataFrame([], schema)
    keys = stage(asked.select(key).distinct())
    buckets = {r[0] for r in keys.select(bucket_of(F.col(key), found.buckets)).distinct().collect()}
    return _rows(spark, schema, [f for b, f in sorted(found.folders.items()) if b in buckets]).join(keys, key, "left_semi")


def newest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the latest by ``order`` (null first), at a tie that of the smaller hash."""
    rest = sorted(c for c in batch.columns if c not in (key, order))
    latest = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*rest))
    return batch.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")


def merge(spark: SparkSession, root: str, batch: DataFrame, key: str = "id", order: str = "retrieved_at", buckets: int = BUCKETS) -> Version:
    """Write the next version: the batch wins over stored rows of its keys, and within the batch the latest by ``order``.

    The work grows with the batch and the buckets it touches: other buckets are neither read nor written. Keys are not null. ``buckets`` counts
    for a new table only; a stored one keeps its own. A batch without rows changes nothing.
    """
    held = read_version(spark, root) or Version(0, buckets, {})
    fresh = stage(newest(batch, key, order).withColumn("bucket", bucket_of(F.col(key), held.buckets)))
    touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())
    if not touched:
        drop(fresh)
        return held
    stored = _rows(spark, batch.schema, [held.folders[b] for b in touched if b in held.folders])
    kept = stored.join(fresh.select(key), key, "left_anti").select(*batch.columns, bucket_of(F.col(key), held.buckets).alias("bucket"))
    folder = f"{root}/data/{uuid.uuid4().hex}"
    merged = kept.unionByName(fresh).repartition(len(touched), "bucket").sortWithinPartitions("bucket", key)
    merged.write.partitionBy("bucket").parquet(folder)
    drop(fresh)
    found = Version(held.number + 1, held.buckets, held.folders | {b: f"{folder}/bucket={b}" for b in touched})
    lines = [(found.number, found.buckets, b, f) for b, f in sorted(found.folders.items())]
    manifest = spark.createDataFrame(lines, MANIFEST).coalesce(1).drop("version")
    manifest.write.mode("errorifexists").parquet(f"{root}/manifest/version={found.number}")
    return found
