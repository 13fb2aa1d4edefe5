"""Side expansion and test-game selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.functions.expr import hours_before


def team_games(games: DataFrame) -> DataFrame:
    """Two rows per game, one from each side, in one pass over the games."""
    def side(home: bool) -> Column:
        own, other = ("home", "away") if home else ("away", "home")
        return F.struct(
            F.lit(home).alias("is_home"),
            F.col(f"{own}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opponent_id"),
            F.coalesce(f"{own}_score", F.lit(0)).cast("bigint").alias("points_for"),
            F.coalesce(f"{other}_score", F.lit(0)).cast("bigint").alias("points_against"),
        )

    keep = [c for c in games.columns if c not in ("home_team_id", "away_team_id", "home_score", "away_score")]
    return games.withColumn("_side", F.explode(F.array(side(True), side(False)))).select(*keep, "_side.*")


def scoring_facts(games: DataFrame) -> DataFrame:
    """Side rows that may count toward strength: completed regular-season games."""
    return team_games(games.filter((F.col("season_type") == "regular") & F.col("completed")))


def select_test_games(games: DataFrame, seasons: Sequence[int] | None = None) -> DataFrame:
    """Completed regular-season games of the wanted seasons. Order is left to the sink."""
    chosen = games.filter((F.col("season_type") == "regular") & F.col("completed"))
    return chosen.filter(F.col("season_year").isin(list(seasons))) if seasons is not None else chosen


def with_cutoff(games: DataFrame, lead_hours: int = K.FORECAST_LEAD_HOURS) -> DataFrame:
    """Attach the feature cutoff, ``lead_hours`` before kickoff."""
    return games.withColumn("cutoff", hours_before(F.col("kickoff_at"), lead_hours) if lead_hours else F.col("kickoff_at"))


def with_result(games: DataFrame) -> DataFrame:
    """Tie flag and home-win outcome (null for a tie)."""
    tie = F.col("home_score") == F.col("away_score")
    return games.withColumn("is_tie", tie).withColumn(
        "home_won",
        F.when(~tie, (F.coalesce("home_score", F.lit(0)) > F.coalesce("away_score", F.lit(0))).cast("int")),
    )


def side_probes(games: DataFrame) -> DataFrame:
    """Distinct (team, season, cutoff) asked for by either side of ``games``."""
    return (
        games.withColumn("team_id", F.explode(F.array("home_team_id", "away_team_id")))
        .select("team_id", "season_year", "cutoff")
        .distinct()
    )


def attach_sides(games: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Join per-(team, season, cutoff) features to a game's home and away side.

    Features are unique per key, so the join sides never multiply rows; sort-merge
    or broadcast is left to the optimizer's size statistics.
    """
    def renamed(prefix: str) -> DataFrame:
        return features.select(
            F.col("team_id").alias(f"{prefix}_team_id"),
            "season_year",
            "cutoff",
            *[F.col(c).alias(f"{prefix}_{c}") for c in columns],
        )

    return games.join(renamed("home"), ["home_team_id", "season_year", "cutoff"], "left").join(
        renamed("away"), ["away_team_id", "season_year", "cutoff"], "left"
    )
