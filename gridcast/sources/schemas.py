"""Explicit schemas of the stored tables and of the landed JSON. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

SNAPSHOT_REF = "struct<provider: string, path: string, source_url: string, retrieved_at: timestamp, sha256: string>"
PREFIX = (
    "entity_type string, id string, provider_ids map<string, string>, event_time timestamp, retrieved_at timestamp, "
    f"source_snapshots array<{SNAPSHOT_REF}>, schema_version string"
)
LEVELS = "array<struct<price_dollars: decimal(9,6), contracts: decimal(18,6)>>"

OWN_COLUMNS = {
    "team": "abbreviation string, display_name string",
    "game": (
        "season_year int, season_type string, week int, home_team_id string, away_team_id string, kickoff_at timestamp, "
        "status string, completed boolean, neutral_site boolean, home_score int, away_score int"
    ),
    "team_strength_snapshot": (
        "team_id string, season_year int, through_week int, feature_cutoff_at timestamp, games_played int, points_for int, "
        "points_against int, exponent decimal(9,6), strength decimal(9,6)"
    ),
    "kalshi_event": "ticker string, title string, scheduled_at timestamp, settlement_source string",
    "kalshi_market": (
        "kalshi_event_id string, ticker string, title string, open_at timestamp, close_at timestamp, fee_type string, rules_primary string"
    ),
    "orderbook_snapshot": f"market_id string, observed_at timestamp, yes_bids {LEVELS}, no_bids {LEVELS}",
    "forecast": (
        "game_id string, model_version string, feature_cutoff_at timestamp, forecast_created_at timestamp, "
        "home_win_probability decimal(9,6), tie_probability decimal(9,6), uncertainty decimal(9,6), exponent decimal(9,6), "
        "home_games_played int, away_games_played int, home_shrinkage_weight decimal(9,6), away_shrinkage_weight decimal(9,6), "
        "training_window_start timestamp, home_field_applied boolean, calibration_version string, abstained boolean, "
        "injury_adjustment decimal(9,6), injury_adjusted_player_ids array<string>"
    ),
    "match_decision": "game_id string, market_id string, forecast_id string, decision_at timestamp, status string, reason string",
    "paper_recommendation": (
        "match_decision_id string, quote_snapshot_id string, recommendation_at timestamp, side string, "
        "entry_price_dollars decimal(9,6), max_loss_dollars decimal(18,6), net_edge decimal(9,6)"
    ),
    "outcome": (
        "game_id string, market_id string, settled_at timestamp, home_score int, away_score int, market_payout_dollars decimal(9,6)"
    ),
    "availability_report": (
        "player_id string, team_id string, game_id string, report_class string, status_text string, description string, "
        "source_confidence decimal(9,6), correction_state string"
    ),
    "player_game_statline": (
        "player_id string, team_id string, game_id string, stat_category string, stat_labels array<string>, stat_values array<string>"
    ),
}


def ddl(entity: str) -> str:
    return f"{PREFIX}, {OWN_COLUMNS[entity]}"


def schema_of(entity: str) -> T.StructType:
    return T.StructType.fromDDL(ddl(entity))


TEAM = "struct<id: string, abbreviation: string, displayName: string>"
ATHLETE = "struct<id: string, displayName: string, position: struct<abbreviation: string, displayName: string>>"
# Scores and flags are read as text, so a value of the wrong kind is seen instead of nulled away. A competition is first kept as its
# JSON text: only there a flag can be told from a text that spells one.
SCOREBOARD = (
    "events array<struct<id: string, date: string, season: struct<year: bigint, type: bigint>, week: struct<number: bigint>, competitions: array<string>>>"
)
COMPETITION = (
    "neutralSite string, status struct<type: struct<name: string, completed: string>>, "
    f"competitors array<struct<homeAway: string, score: string, team: {TEAM}>>"
)
SUMMARY = (
    f"boxscore struct<players: array<struct<team: {TEAM}, statistics: array<struct<name: string, labels: array<string>, "
    f"athletes: array<struct<athlete: {ATHLETE}, stats: array<string>>>>>>>>, "
    f"injuries array<struct<team: {TEAM}, injuries: array<struct<status: string, date: string, athlete: {ATHLETE}>>>>"
)
ODDS = (
    "array<struct<id: string, home_team: string, away_team: string, commence_time: string, bookmakers: array<struct<key: string, "
    "markets: array<struct<key: string, outcomes: array<struct<name: string, price: double>>>>>>>>"
)
MARKETS = "markets array<struct<id: string, ticker: string, title: string, yes_ask: double, no_ask: double, volume: double>>"
