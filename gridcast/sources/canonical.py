"""Canonical rows: stable keys, validation, season coverage and the jobs that fill the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.sources.landed import blank, has_sensitive_key


def record_key(entity: str, *parts: Column) -> Column:
    """``entity:`` plus 32 hex digits that depend only on the identity parts; null when one is blank.

    Same shape and stability as a name-based UUID, made with the built-in hash.
    """
    texts = [F.trim(p.cast("string")) for p in parts]
    bad = blank(texts[0])
    for text in texts[1:]:
        bad = bad | blank(text)
    digest = F.sha2(F.concat(F.lit(entity.lower() + "\x1e"), F.concat_ws("\x1f", *texts)), 256)
    return F.when(~bad, F.concat(F.lit(f"{entity.lower()}:"), F.substring(digest, 1, 32)))


def with_violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add the array of broken rules. A rule that cannot be evaluated (null) counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken)))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter(F.size("violations") == 0).drop("violations"), rows.filter(F.size("violations") > 0)


def record_rules() -> dict[str, Column]:
    """Rules every stored row must meet."""
    ids = F.col("provider_ids")
    return {
        "id": F.col("id").rlike("^[a-z][a-z0-9_-]*:[0-9a-f]{32}$"),
        "provider_ids": (F.size(ids) > 0) & ~has_sensitive_key(ids) & F.forall(F.map_entries(ids), lambda e: ~blank(e["key"]) & ~blank(e["value"])),
        "event_time": F.col("event_time").isNotNull(),
        "retrieved_at": F.col("retrieved_at").isNotNull(),
        "schema_version": F.col("schema_version") == K.SCHEMA_VERSION,
    }


def game_rules() -> dict[str, Column]:
    unsigned = lambda c: F.col(c).isNull() | (F.col(c) >= 0)
    return {
        "season_year": F.col("season_year") >= 2000,
        "season_type": F.col("season_type").isin(*K.SEASON_TYPE_CODES.values()),
        "week": F.col("week").between(1, 25),
        "scores": unsigned("home_score") & unsigned("away_score"),
        "completion": ~F.col("completed") | (F.col("home_score").isNotNull() & F.col("away_score").isNotNull()),
    }


def forecast_rules() -> dict[str, Column]:
    unit = lambda c: F.col(c).between(0, 1)
    return {
        "probability": unit("home_win_probability"),
        "probability_sum": F.col("home_win_probability") + F.col("tie_probability") <= 1,
        "uncertainty": unit("uncertainty"),
        "training_window": F.col("training_window_start") <= F.col("feature_cutoff_at"),
    }


def statline_rules() -> dict[str, Column]:
    return {
        "player_id": ~blank(F.col("player_id")),
        "category": ~blank(F.col("stat_category")),
        "labels": F.size("stat_labels") > 0,
        "lengths": F.size("stat_labels") == F.size("stat_values"),
    }


def entity_rules(entity: str) -> dict[str, Column]:
    """Rules of an entity's own columns, by name. Together with :func:`record_rules` they are all a stored row must meet."""
    filled = lambda c: ~blank(F.col(c))
    known = lambda c: F.col(c).isNotNull()
    unit = lambda c: F.col(c).between(0, 1)
    natural = lambda c: F.col(c) >= 0
    levels = lambda c: F.forall(c, lambda x: F.coalesce(x["price_dollars"].between(0, 1) & (x["contracts"] > 0), F.lit(False)))
    rules = {
        "team": lambda: {"abbreviation": F.char_length("abbreviation").between(2, 5), "display_name": filled("display_name")},
        "game": game_rules,
        "team_strength_snapshot": lambda: {
            "season_year": F.col("season_year") >= 2000, "through_week": F.col("through_week").between(0, 25), "games_played": natural("games_played"),
            "points": natural("points_for") & natural("points_against"), "exponent": F.col("exponent") > 0, "strength": unit("strength"),
        },
        "kalshi_event": lambda: {"ticker": filled("ticker"), "title": filled("title"), "scheduled_at": known("scheduled_at"), "settlement_source": filled("settlement_source")},
        "kalshi_market": lambda: {
            "ticker": filled("ticker"), "title": filled("title"), "open_at": known("open_at"), "close_at": known("close_at"),
            "fee_type": filled("fee_type"), "rules_primary": filled("rules_primary"),
        },
        "orderbook_snapshot": lambda: {"observed_at": known("observed_at"), "yes_bids": levels("yes_bids"), "no_bids": levels("no_bids")},
        "forecast": forecast_rules,
        "match_decision": lambda: {"decision_at": known("decision_at"), "status": F.col("status").isin("eligible", "rejected"), "reason": filled("reason")},
        "paper_recommendation": lambda: {"side": F.col("side").isin("yes", "no"), "entry_price": unit("entry_price_dollars"), "max_loss": F.col("max_loss_dollars") > 0},
        "outcome": lambda: {"settled_at": known("settled_at"), "scores": natural("home_score") & natural("away_score"), "payout": unit("market_payout_dollars")},
        "availability_report": lambda: {
            "player_id": filled("player_id"),
            "report_class": F.col("report_class").isin("roster_status", "injury_status", "practice_participation", "gameday_inactive", "in_game_incident"),
            "status_text": filled("status_text"), "source_confidence": unit("source_confidence"),
            "correction_state": F.col("correction_state").isin("original", "corrected", "retracted"),
        },
        "player_game_statline": statline_rules,
    }
    return rules[entity]()


def season_events(games: DataFrame, order: str = "retrieved_at") -> DataFrame:
    """Landed games of a requested season, one row per event: the first copy and how often it came.

    ``requested_season`` is the season a game was asked for under. Copies are folded
    by an aggregation, so an event landed very often is reduced before it is shuffled.
    """
    fits = (F.col("season_year") == F.col("requested_season")) & (F.col("season_type") == "regular")
    rest = [c for c in games.columns if c not in ("requested_season", "event_id")]
    first = F.min_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*sorted(rest))))
    return (
        games.withColumn("fits", fits)
        .groupBy("requested_season", "event_id", "fits")
        .agg(F.count(F.lit(1)).alias("copies"), first.alias("_first"))
        .select("requested_season", "event_id", "fits", "copies", "_first.*")
    )


def accepted_games(events: DataFrame) -> DataFrame:
    return events.filter("fits").drop("fits", "copies")


def season_problems(events: DataFrame, require_completed: bool = True) -> DataFrame:
    """Events with a problem: inconsistent with the request, landed more than once, or not completed."""
    problems = F.array_compact(
        F.array(
            F.when(~F.col("fits"), F.lit("inconsistent")),
            F.when(F.col("fits") & (F.col("copies") > 1), F.lit("duplicate")),
            F.when(F.col("fits") & F.lit(require_completed) & ~F.col("completed"), F.lit("incomplete")),
        )
    )
    return events.select("requested_season", "event_id", "copies", F.explode(problems).alias("problem"))


def season_coverage(
    events: DataFrame,
    require_completed: bool = True,
    expected_games: int = K.EXPECTED_SEASON_GAMES,
    expected_teams: int = K.EXPECTED_SEASON_TEAMS,
) -> DataFrame:
    """Per requested season: games and teams captured against expected, problem counts, and the gate."""
    fits = F.col("fits")
    count = lambda c: F.sum(c.cast("bigint"))
    counts = events.groupBy("requested_season").agg(
        count(fits).alias("games_captured"),
        F.sum(F.when(fits, F.col("copies") - 1).otherwise(0)).alias("duplicates"),
        F.sum(F.when(~fits, F.col("copies")).otherwise(0)).alias("inconsistent"),
        count(fits & F.lit(require_completed) & ~F.col("completed")).alias("incomplete"),
    )
    teams = (
        events.filter(fits)
        .select("requested_season", F.explode(F.array("home_team_id", "away_team_id")).alias("team"))
        .groupBy("requested_season")
        .agg(F.countDistinct("team").alias("teams_captured"))
    )
    clean = (F.col("duplicates") == 0) & (F.col("inconsistent") == 0) & (F.col("incomplete") == 0)
    return counts.join(teams, "requested_season", "left").fillna(0, ["teams_captured"]).withColumn(
        "is_complete", clean & (F.col("games_captured") == expected_games) & (F.col("teams_captured") == expected_teams)
    )


def canonical_teams(games: DataFrame, provider: str) -> DataFrame:
    """One row per team seen on either side, its latest naming winning."""
    side = lambda s: F.struct(
        F.col(f"{s}_team_id").alias("provider_team_id"), F.col(f"{s}_team_abbreviation").alias("abbreviation"),
        F.col(f"{s}_team_name").alias("display_name"),
    )
    seen = games.select("retrieved_at", "event_id", F.explode(F.array(side("home"), side("away"))).alias("_t")).select("retrieved_at", "event_id", "_t.*")
    latest = seen.groupBy("provider_team_id").agg(
        F.max_by(F.struct("abbreviation", "display_name", "retrieved_at"), F.struct("retrieved_at", "event_id")).alias("_l")
    )
    return latest.select(
        record_key("team", F.lit(provider), F.col("provider_team_id")).alias("id"), "provider_team_id", "_l.abbreviation", "_l.display_name",
        F.col("_l.retrieved_at").alias("retrieved_at"),
    )


def canonical_games(games: DataFrame, provider: str) -> DataFrame:
    key = lambda entity, c: record_key(entity, F.lit(provider), F.col(c))
    return games.select(
        key("game", "event_id").alias("id"), "event_id", "season_year", "season_type", "week",
        key("team", "home_team_id").alias("home_team_id"), key("team", "away_team_id").alias("away_team_id"),
        "kickoff_at", "status", "completed", "neutral_site", "home_score", "away_score", "retrieved_at",
    )


def canonical_statlines(lines: DataFrame, provider: str) -> DataFrame:
    """Statline rows keyed by event, athlete and category."""
    p = F.lit(provider)
    return lines.select(
        record_key("player_game_statline", p, F.col("event_id"), F.col("athlete_id"), F.col("stat_category")).alias("id"),
        record_key("player", p, F.col("athlete_id")).alias("player_id"),
        record_key("team", p, F.col("team_id")).alias("team_id"),
        record_key("game", p, F.col("event_id")).alias("game_id"),
        "stat_category", "stat_labels", "stat_values",
    )


def canonical_injuries(rows: DataFrame, provider: str) -> DataFrame:
    """Availability rows keyed by athlete and retrieval, so a later fetch adds instead of replacing."""
    p = F.lit(provider)
    return rows.select(
        record_key("availability_report", p, F.col("athlete_id"), F.col("retrieved_at")).alias("id"),
        record_key("player", p, F.col("athlete_id")).alias("player_id"),
        record_key("team", p, F.col("team_id")).alias("team_id"),
        record_key("game", p, F.col("event_id")).alias("game_id"),
        F.lit("injury_status").alias("report_class"), "status_text",
        F.col("reported_at").alias("event_time"), "retrieved_at",
        F.lit(K.INJURY_REPORT_CONFIDENCE).alias("source_confidence"), F.lit("original").alias("correction_state"),
    )


def backfill_report(games: DataFrame, lines: DataFrame, seasons: Sequence[int] | None = None) -> DataFrame:
    """Stat lines found for every completed regular game; zero for a game without any."""
    wanted = games.filter((F.col("season_type") == "regular") & F.col("completed"))
    if seasons is not None:
        wanted = wanted.filter(F.col("season_year").isin(list(seasons)))
    found = lines.groupBy("game_id").agg(F.count(F.lit(1)).alias("statlines"))
    return wanted.select("game_id", "season_year").join(found, "game_id", "left").fillna(0, ["statlines"])


def open_game_reports(reports: DataFrame, games: DataFrame) -> DataFrame:
    """Reports that belong to a regular game not completed yet; today's report says nothing about a past game."""
    still_open = games.filter((F.col("season_type") == "regular") & ~F.col("completed")).select("game_id")
    return reports.join(still_open, "game_id", "left_semi")
