"""Stored entity tables: upsert, versioned publishing, version-routed loading and lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.sources import schemas as S

Migration = Callable[[DataFrame], DataFrame]


def upsert(existing: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both with the batch winning per key, and within a side the latest retrieval."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    rest = sorted(c for c in existing.columns if c not in (key, "retrieved_at"))
    latest = Window.partitionBy(key).orderBy(F.col("_new").desc(), F.col("retrieved_at").desc(), F.xxhash64(*rest))
    return both.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank", "_new")


def publish(rows: DataFrame, root: str, entity: str, version: str, key: str = "id") -> str:
    """Write a whole table version sorted by key and return its folder; readers name the version they want."""
    path = f"{root}/{entity}/version={version}"
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)
    return path


def load_table(spark: SparkSession, root: str, entity: str, version: str | None) -> DataFrame:
    """A published version with its fixed schema; an entity never written reads as empty."""
    schema = S.schema_of(entity)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{entity}/version={version}")


def read_by_id(table: DataFrame, asked: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``table`` whose key is in ``asked``, and the asked keys that no row has."""
    keys = asked.select(key).distinct()
    return table.join(keys, key, "left_semi"), keys.join(table, key, "left_anti")


def load_records(payloads: DataFrame, entity: str, migrations: dict[str, Migration] | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed rows of one entity from JSON payloads of any known version, and the rest with a problem.

    ``migrations`` maps an old version to a function that rewrites the ``payload``
    column. A payload of another version without one is refused, never guessed at.
    """
    head = payloads.withColumn("_h", F.from_json("payload", "entity_type string, schema_version string"))
    typed = head.withColumn("_type", F.col("_h.entity_type")).withColumn("_version", F.col("_h.schema_version")).drop("_h")
    known = F.col("_type").isin(*S.OWN_COLUMNS)
    problems = [typed.filter(~F.coalesce(known, F.lit(False))).withColumn("problem", F.lit("unknown entity type"))]
    mine = typed.filter(F.col("_type") == entity)
    current = mine.filter(F.col("_version") == K.SCHEMA_VERSION)
    for version, migrate in (migrations or {}).items():
        moved = migrate(mine.filter(F.col("_version") == version)).withColumn(
            "_version", F.get_json_object("payload", "$.schema_version")
        )
        current = current.unionByName(moved.filter(F.col("_version") == K.SCHEMA_VERSION))
        problems.append(
            moved.filter(~F.coalesce(F.col("_version") == K.SCHEMA_VERSION, F.lit(False))).withColumn(
                "problem", F.lit("migration did not reach the current version")
            )
        )
    routed = [K.SCHEMA_VERSION, *(migrations or {})]
    problems.append(
        mine.filter(~F.coalesce(F.col("_version").isin(routed), F.lit(False))).withColumn("problem", F.lit("incompatible schema version"))
    )
    rows = current.select(F.from_json("payload", S.ddl(entity)).alias("_r")).select("_r.*")
    bad = problems[0]
    for more in problems[1:]:
        bad = bad.unionByName(more)
    return rows, bad.select("payload", F.col("_type").alias("entity_type"), F.col("_version").alias("schema_version"), "problem")


def lineage(
    recommendations: DataFrame, decisions: DataFrame, quotes: DataFrame, forecasts: DataFrame,
    games: DataFrame, markets: DataFrame, outcomes: DataFrame,
) -> DataFrame:
    """Everything behind every recommendation in one row, with the first broken reference or time order.

    All tables are keyed by id; the outcome is optional and found by game and market.
    """
    pick = lambda df, prefix, *cols: df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("id", *cols)])
    df = (
        recommendations.select(
            F.col("id").alias("recommendation_id"), F.col("match_decision_id").alias("decision_id"),
            F.col("quote_snapshot_id").alias("quote_id"), "recommendation_at",
        )
        .join(pick(decisions, "decision", "game_id", "market_id", "forecast_id", "decision_at"), "decision_id", "left")
        .join(pick(quotes, "quote", "market_id", "observed_at"), "quote_id", "left")
        .withColumn("forecast_id", F.col("decision_forecast_id"))
        .join(pick(forecasts, "forecast", "game_id", "feature_cutoff_at", "forecast_created_at"), "forecast_id", "left")
        .withColumn("game_id", F.col("decision_game_id"))
        .join(pick(games, "game", "kickoff_at"), "game_id", "left")
        .withColumn("market_id", F.col("decision_market_id"))
        .join(markets.select(F.col("id").alias("market_id"), F.lit(True).alias("_market")), "market_id", "left")
        .join(
            outcomes.select("game_id", "market_id", F.col("id").alias("outcome_id"), "settled_at"), ["game_id", "market_id"], "left"
        )
    )
    moments = F.array(
        "forecast_feature_cutoff_at", "forecast_forecast_created_at", "quote_observed_at", "decision_decision_at",
        "recommendation_at", "game_kickoff_at",
    )
    problem = (
        F.when(F.col("decision_game_id").isNull(), "no decision")
        .when(F.col("quote_market_id").isNull(), "no quote")
        .when(F.col("forecast_game_id").isNull(), "no forecast")
        .when(F.col("game_kickoff_at").isNull(), "no game")
        .when(F.col("_market").isNull(), "no market")
        .when(F.col("forecast_game_id") != F.col("game_id"), "forecast of another game")
        .when(F.col("quote_market_id") != F.col("market_id"), "quote of another market")
        .when(F.array_sort(moments) != moments, "times out of order")
        .when(F.col("settled_at") < F.col("game_kickoff_at"), "settled before kickoff")
    )
    return df.select(
        "recommendation_id", "decision_id", "quote_id", "forecast_id", "game_id", "market_id", "outcome_id", problem.alias("problem")
    )
