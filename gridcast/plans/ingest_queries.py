"""Queries over landing, normalization, validation and the stored tables.

The landed JSON is written from the mapped views with ``to_json``; a fixed share of
it is broken in known ways so the quarantine is exercised too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.plans.fixtures import Tables
from gridcast.plans.registry import big, cte, q6, qstamp, query, r6, stamp, with_ctes
from gridcast.session import shared_folder, spread
from gridcast.sources import bucketed
from gridcast.sources import canonical as C
from gridcast.sources import landed as L
from gridcast.sources import schemas as S
from gridcast.sources import store


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm'Z'")


def stage_path(spark) -> str:
    """A new folder among the staged tables of this application."""
    return f"{shared_folder(spark)}/gridcast-stage/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def team_struct(prefix: str) -> Column:
    return F.struct(text(f"{prefix}_team_id").alias("id"), F.col(f"{prefix}_abbr").alias("abbreviation"), F.col(f"{prefix}_name").alias("displayName"))


def with_names(t: Tables) -> DataFrame:
    games = t.games()
    for side in ("home", "away"):
        names = t.teams().select(F.col("team_id").alias(f"{side}_team_id"), F.col("abbreviation").alias(f"{side}_abbr"), F.col("display_name").alias(f"{side}_name"))
        games = games.join(names, f"{side}_team_id")
    return games


def landed_scoreboards(t: Tables) -> DataFrame:
    """One payload per game; some carry no away side, an unreadable score, an unknown season phase or a flag spelled as text, some are cut short.

    Seasons are numbered ten years on, as seasons before 2000 are refused.
    """
    gid = F.col("game_id")
    phase = F.when(gid % 83 == 0, 9).when(F.col("season_type") == "preseason", 1).otherwise(2)
    home_score = F.when(gid % 89 == 0, F.concat(F.lit("x"), text("home_score"))).otherwise(text("home_score"))
    home = F.struct(F.lit("home").alias("homeAway"), home_score.alias("score"), team_struct("home").alias("team"))
    away = F.struct(F.lit("away").alias("homeAway"), text("away_score").alias("score"), team_struct("away").alias("team"))
    sides = F.when(gid % 97 == 0, F.array(home)).otherwise(F.array(away, home))
    comp = F.struct(
        F.col("neutral_site").alias("neutralSite"),
        F.struct(F.struct(F.when(F.col("completed"), "final").otherwise("scheduled").alias("name"), F.col("completed")).alias("type")).alias("status"),
        sides.alias("competitors"),
    )
    event = F.struct(
        text("game_id").alias("id"), iso(F.col("kickoff_at")).alias("date"),
        F.struct((F.col("season_year") + 10).alias("year"), phase.alias("type")).alias("season"),
        F.struct(F.col("week").alias("number")).alias("week"), F.array(comp).alias("competitions"),
    )
    return with_names(t).select(
        F.lit("scoreboard").alias("provider"),
        F.concat(F.lit("https://feed.example/scoreboard?event="), text("game_id")).alias("source_url"),
        (F.col("kickoff_at") + F.expr("INTERVAL 6 HOUR")).alias("retrieved_at"),
        F.to_json(F.struct(F.array(event).alias("events"))).alias("payload"),
        gid.alias("_game"),
    ).select("provider", "source_url", "retrieved_at", _spoiled("payload").alias("payload"))


def _spoiled(payload: str) -> Column:
    game = F.col("_game")
    cut = F.substring(payload, 1, 60)
    return F.when(game % 71 == 0, cut).when(game % 79 == 0, F.regexp_replace(payload, '"completed":(true|false)', '"completed":"$1"')).otherwise(F.col(payload))


cte("landed_games", """
SELECT g.*, h.abbreviation AS ha, h.display_name AS hn, a.abbreviation AS aa, a.display_name AS an,
  CASE WHEN game_id % 71 = 0 THEN 'events' WHEN game_id % 83 = 0 THEN 'season type' WHEN game_id % 97 = 0 THEN 'competitors' WHEN game_id % 79 = 0 THEN 'completed'
       WHEN game_id % 89 = 0 AND home_score IS NOT NULL THEN 'score' END AS problem
FROM games AS g JOIN teams AS h ON h.team_id = home_team_id JOIN teams AS a ON a.team_id = away_team_id""")


@query("s7_scoreboard", with_ctes(f"""
SELECT game_id::VARCHAR AS event_id, season_year::BIGINT + 10 AS season_year, CASE WHEN problem IS NULL THEN season_type END AS season_type, week::BIGINT AS week,
       {qstamp('kickoff_at')} AS kickoff_at, completed, neutral_site, home_team_id::VARCHAR AS home_team_id, ha AS home_team_abbreviation,
       CASE WHEN problem IS NULL THEN home_score::BIGINT END AS home_score, CASE WHEN problem IS NULL THEN away_score::BIGINT END AS away_score, problem
FROM landed_games WHERE problem IS DISTINCT FROM 'events'
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, problem FROM landed_games WHERE problem = 'events'"""))
def _(t: Tables) -> DataFrame:
    ok = F.col("problem").isNull()
    return L.scoreboard_games(spread(landed_scoreboards(t), "source_url")).select(
        "event_id", big("season_year"), F.when(ok, F.col("season_type")).alias("season_type"), big("week"), stamp("kickoff_at"), "completed", "neutral_site",
        "home_team_id", "home_team_abbreviation", F.when(ok, F.col("home_score")).cast("bigint").alias("home_score"),
        F.when(ok, F.col("away_score")).cast("bigint").alias("away_score"), "problem")


def normalized_games(t: Tables) -> DataFrame:
    return L.scoreboard_games(spread(landed_scoreboards(t), "source_url")).filter("problem IS NULL").drop("problem")


@query("s1_append_snapshots", with_ctes(f"""
SELECT game_id, CASE WHEN game_id % 7 = 0 THEN 'sensitive url' WHEN game_id % 5 = 0 OR game_id % 11 = 0 THEN 'conflicting content' ELSE 'new' END AS result FROM games
WHERE game_id % 3 <> 0 OR game_id % 7 = 0
UNION ALL SELECT game_id, 'conflicting content' FROM games WHERE game_id % 11 = 0"""))
def _(t: Tables) -> DataFrame:
    gid = F.col("game_id")
    url = F.concat(F.lit("https://feed.example/g?id="), text("game_id"))
    base = t.games().select(
        "game_id", F.lit("scoreboard").alias("provider"), F.col("kickoff_at").alias("retrieved_at"),
        F.to_json(F.struct("game_id", "home_score")).alias("payload"), url.alias("source_url"))
    # a third is already stored; a fifth is stored under another source; a seventh of the batch leaks a token
    stored = L.snapshot_identity(base.filter(gid % 3 == 0)).unionByName(
        L.snapshot_identity(base.filter((gid % 5 == 0) & (gid % 3 != 0)).withColumn("source_url", F.lit("https://other.example/"))))
    batch = base.withColumn("source_url", F.when(gid % 7 == 0, F.concat("source_url", F.lit("&TOKEN=1"))).otherwise(F.col("source_url")))
    # an eleventh lands under a second source in the same batch
    batch = batch.unionByName(base.filter(gid % 11 == 0).withColumn("source_url", F.lit("https://second.example/")))
    fresh, rejected = L.append_snapshots(stored, batch)
    return fresh.select("game_id", F.lit("new").alias("result")).unionByName(rejected.select("game_id", F.col("problem").alias("result")))


@query("s2_record_keys", with_ctes("""
SELECT game_id, 'game:' || substr(sha256('game' || chr(30) || 'feed' || chr(31) || game_id::VARCHAR), 1, 32) AS id,
       CASE WHEN game_id % 10 <> 0 THEN 'player:' || substr(sha256('player' || chr(30) || 'feed' || chr(31) || home_team_id::VARCHAR), 1, 32) END AS maybe_id FROM games"""))
def _(t: Tables) -> DataFrame:
    part = F.when(F.col("game_id") % 10 == 0, F.lit("  ")).otherwise(text("home_team_id"))
    return t.games().select(
        "game_id", C.record_key("game", F.lit("feed"), F.col("game_id")).alias("id"), C.record_key("Player", F.lit("feed"), part).alias("maybe_id"))


@query("s3_upsert", with_ctes("""
SELECT game_id AS id, CASE WHEN week <= 13 AND season_type = 'regular' THEN 'batch' ELSE 'stored' END AS origin FROM games
WHERE NOT (season_type <> 'regular' AND week > 20) OR week <= 13"""))
def _(t: Tables) -> DataFrame:
    rows = t.games().select(F.col("game_id").alias("id"), F.col("kickoff_at").alias("retrieved_at"), "week", "season_type")
    existing = rows.filter(~((F.col("season_type") != "regular") & (F.col("week") > 20))).withColumn("origin", F.lit("stored"))
    batch = rows.filter((F.col("week") <= 13) & (F.col("season_type") == "regular")).withColumn("origin", F.lit("batch"))
    twice = batch.unionByName(batch.withColumn("retrieved_at", F.col("retrieved_at") - F.expr("INTERVAL 1 DAY")).withColumn("origin", F.lit("older")))
    return store.upsert(existing, twice).select("id", "origin")


@query("s3_bucketed_upsert", with_ctes("""
SELECT game_id AS id, CASE WHEN game_id % 50 = 0 THEN 'second' WHEN week <= 13 AND season_type = 'regular' THEN 'first' ELSE 'stored' END AS origin,
       CASE WHEN week <= 13 AND season_type = 'regular' THEN 'first' WHEN NOT (season_type <> 'regular' AND week > 20) THEN 'stored' END AS before
FROM games WHERE NOT (season_type <> 'regular' AND week > 20) OR week <= 13 OR game_id % 50 = 0"""))
def _(t: Tables) -> DataFrame:
    """The table as two batches left it, next to the version before the second one."""
    rows = t.games().select(F.col("game_id").alias("id"), F.col("kickoff_at").alias("retrieved_at"), "week", "season_type")
    regular = F.col("season_type") == "regular"
    first = rows.filter((F.col("week") <= 13) & regular).withColumn("origin", F.lit("first"))
    older = first.withColumn("retrieved_at", F.col("retrieved_at") - F.expr("INTERVAL 1 DAY")).withColumn("origin", F.lit("older"))
    root = stage_path(t.spark)
    bucketed.merge(t.spark, root, rows.filter(regular | (F.col("week") <= 20)).withColumn("origin", F.lit("stored")), buckets=16)
    earlier = bucketed.merge(t.spark, root, first.unionByName(older))
    bucketed.merge(t.spark, root, rows.filter(F.col("id") % 50 == 0).withColumn("origin", F.lit("second")))
    before = bucketed.read_table(t.spark, root, first.schema, earlier.number).select("id", F.col("origin").alias("before"))
    return bucketed.read_table(t.spark, root, first.schema).select("id", "origin").join(before, "id", "left")


def record_payloads(t: Tables) -> DataFrame:
    """Team payloads of the current version, of an old version under another field name, and unreadable ones."""
    gid = F.col("game_id")
    kind = F.when(gid % 11 == 0, "venue").otherwise("team")
    version = F.when(gid % 13 == 0, "0.8.0").when(gid % 4 == 0, "0.9.0").otherwise(K.SCHEMA_VERSION)
    name = text("home_team_id")
    return t.games().select(
        F.to_json(F.struct(
            kind.alias("entity_type"), version.alias("schema_version"), C.record_key("team", F.lit("feed"), gid).alias("id"),
            F.when(gid % 4 != 0, F.concat(F.lit("T"), name)).alias("abbreviation"),
            F.when(gid % 4 == 0, F.concat(F.lit("T"), name)).alias("short_name"),
            F.concat(F.lit("Team "), name).alias("display_name"),
        )).alias("payload"))


@query("s5_versioned_load", with_ctes("""
SELECT 'team:' || substr(sha256('team' || chr(30) || 'feed' || chr(31) || game_id::VARCHAR), 1, 32) AS id,
       CASE WHEN game_id % 11 <> 0 AND game_id % 13 <> 0 THEN 'T' || home_team_id END AS abbreviation,
       CASE WHEN game_id % 11 = 0 THEN 'unknown entity type' WHEN game_id % 13 = 0 THEN 'incompatible schema version' END AS problem FROM games"""))
def _(t: Tables) -> DataFrame:
    def from_0_9(df: DataFrame) -> DataFrame:
        renamed = F.replace(F.replace("payload", F.lit('"short_name"'), F.lit('"abbreviation"')), F.lit('"0.9.0"'), F.lit(f'"{K.SCHEMA_VERSION}"'))
        return df.withColumn("payload", renamed)

    rows, bad = store.load_records(record_payloads(t), "team", {"0.9.0": from_0_9})
    return rows.select("id", "abbreviation", F.lit(None).cast("string").alias("problem")).unionByName(
        bad.select(F.get_json_object("payload", "$.id").alias("id"), F.lit(None).cast("string").alias("abbreviation"), "problem"))


def chain(t: Tables) -> dict[str, DataFrame]:
    """Recommendation chain of every game, broken at fixed places."""
    g = t.games()
    gid, kick = F.col("game_id"), F.col("kickoff_at")
    back = lambda h: kick - F.make_dt_interval(hours=h if isinstance(h, Column) else F.lit(h))
    return {
        "recommendations": g.select(gid.alias("id"), gid.alias("match_decision_id"), gid.alias("quote_snapshot_id"), back((gid % 24).cast("int")).alias("recommendation_at")),
        "decisions": g.select(gid.alias("id"), gid.alias("game_id"), gid.alias("market_id"), F.when(gid % 11 == 0, gid + 1).otherwise(gid).alias("forecast_id"), back(18).alias("decision_at")),
        "quotes": g.filter(gid % 29 != 0).select(gid.alias("id"), F.when(gid % 31 == 0, gid + 1).otherwise(gid).alias("market_id"), back(20).alias("observed_at")),
        "forecasts": g.select(gid.alias("id"), gid.alias("game_id"), back(24).alias("feature_cutoff_at"), back(23).alias("forecast_created_at")),
        "games": g.select(gid.alias("id"), kick.alias("kickoff_at")),
        "markets": g.filter(gid % 37 != 0).select(gid.alias("id")),
        "outcomes": g.filter("completed").select(gid.alias("id"), gid.alias("game_id"), gid.alias("market_id"), (kick + F.make_dt_interval(hours=(gid % 5 - 1).cast("int"))).alias("settled_at")),
    }


LINEAGE_SQL = """
SELECT g.game_id AS recommendation_id, CASE WHEN g.completed THEN g.game_id END AS outcome_id,
  CASE WHEN g.game_id % 29 = 0 THEN 'no quote'
       WHEN g.game_id % 11 = 0 AND n.game_id IS NULL THEN 'no forecast'
       WHEN g.game_id % 37 = 0 THEN 'no market'
       WHEN g.game_id % 11 = 0 THEN 'forecast of another game'
       WHEN g.game_id % 31 = 0 THEN 'quote of another market'
       WHEN g.game_id % 24 > 18 THEN 'times out of order'
       WHEN g.completed AND g.game_id % 5 = 0 THEN 'settled before kickoff' END AS problem
FROM games AS g LEFT JOIN games AS n ON n.game_id = g.game_id + 1"""


@query("s6_lineage", with_ctes(LINEAGE_SQL))
def _(t: Tables) -> DataFrame:
    return store.lineage(**chain(t)).select("recommendation_id", "outcome_id", "problem")


@query("j11_outcome_lookup", with_ctes("SELECT game_id, completed AS settled FROM games"))
def _(t: Tables) -> DataFrame:
    return store.lineage(**chain(t)).select(F.col("recommendation_id").alias("game_id"), F.col("outcome_id").isNotNull().alias("settled"))


def landed_summaries(t: Tables) -> DataFrame:
    """One summary per stat line; a few miss the athlete id."""
    names = t.teams().select("team_id", F.col("abbreviation").alias("abbr"), F.col("display_name").alias("name"))
    team = F.struct(text("team_id").alias("id"), F.col("abbr").alias("abbreviation"), F.col("name").alias("displayName"))
    athlete = F.struct(F.when(F.col("game_id") % 41 != 0, text("player_id")).alias("id"), F.concat(F.lit("Player "), text("player_id")).alias("displayName"))
    entry = F.struct(athlete.alias("athlete"), F.col("stat_values").alias("stats"))
    category = F.struct(F.col("stat_category").alias("name"), F.col("stat_labels").alias("labels"), F.array(entry).alias("athletes"))
    block = F.struct(team.alias("team"), F.array(category).alias("statistics"))
    return t.statlines().join(names, "team_id").select(
        text("game_id").alias("event_id"), F.to_json(F.struct(F.struct(F.array(block).alias("players")).alias("boxscore"))).alias("payload"))


@query("s8_boxscore", with_ctes("""
SELECT game_id::VARCHAR AS event_id, s.team_id::VARCHAR AS team_id, abbreviation AS team_abbreviation, CASE WHEN game_id % 41 <> 0 THEN player_id::VARCHAR END AS athlete_id,
       stat_category, array_to_string(stat_labels, ',') AS labels, array_to_string(stat_values, ',') AS values_text, CASE WHEN game_id % 41 = 0 THEN 'athlete' END AS problem
FROM statlines AS s JOIN teams AS t ON t.team_id = s.team_id"""))
def _(t: Tables) -> DataFrame:
    return L.boxscore_statlines(landed_summaries(t)).select(
        "event_id", "team_id", "team_abbreviation", "athlete_id", "stat_category",
        F.array_join("stat_labels", ",").alias("labels"), F.array_join("stat_values", ",").alias("values_text"), "problem")


@query("p13_statline_rows", with_ctes("""
SELECT 'player:' || substr(sha256('player' || chr(30) || 'feed' || chr(31) || player_id), 1, 32) AS player_id,
       'game:' || substr(sha256('game' || chr(30) || 'feed' || chr(31) || game_id), 1, 32) AS game_id,
       'player_game_statline:' || substr(sha256('player_game_statline' || chr(30) || 'feed' || chr(31) || game_id || chr(31) || player_id || chr(31) || stat_category), 1, 32) AS id
FROM statlines WHERE game_id % 41 <> 0"""))
def _(t: Tables) -> DataFrame:
    good, _bad = L.split_events(L.boxscore_statlines(landed_summaries(t)))
    return C.canonical_statlines(good, "feed").select("id", "player_id", "game_id")


@query("s9_injuries", with_ctes(f"""
SELECT report_id::VARCHAR AS event_id, player_id::VARCHAR AS athlete_id, status_text, {qstamp("date_trunc('minute', event_time)")} AS reported_at, CASE WHEN report_id % 19 = 0 THEN 'date' END AS problem
FROM reports WHERE report_id % 19 <> 0
UNION ALL SELECT report_id::VARCHAR, player_id::VARCHAR, status_text, NULL, 'date' FROM reports WHERE report_id % 19 = 0"""))
def _(t: Tables) -> DataFrame:
    team = F.struct(F.lit("1").alias("id"), F.lit("T1").alias("abbreviation"), F.lit("Team 1").alias("displayName"))
    athlete = F.struct(text("player_id").alias("id"), F.concat(F.lit("Player "), text("player_id")).alias("displayName"))
    date = F.when(F.col("report_id") % 19 == 0, F.lit("2024-01-05 10:00")).otherwise(iso(F.col("event_time")))
    item = F.struct(F.col("status_text").alias("status"), date.alias("date"), athlete.alias("athlete"))
    block = F.struct(team.alias("team"), F.array(item).alias("injuries"))
    landed = t.reports().select(text("report_id").alias("event_id"), F.to_json(F.struct(F.array(block).alias("injuries"))).alias("payload"))
    return L.injury_reports(landed).select("event_id", "athlete_id", "status_text", stamp("reported_at"), "problem")


@query("s10_book_odds", with_ctes(f"""
SELECT event_id::VARCHAR AS event_id, book::VARCHAR AS book, {q6('home_decimal_odds')} AS home_decimal_odds, CASE WHEN book % 10 <> 0 THEN {q6('away_decimal_odds')} END AS away_decimal_odds,
       CASE WHEN book % 10 = 0 THEN 'prices' END AS problem FROM book_odds WHERE event_id % 13 <> 0
UNION ALL SELECT DISTINCT ON (event_id) '', '', NULL, NULL, 'events' FROM book_odds WHERE event_id % 13 = 0"""))
def _(t: Tables) -> DataFrame:
    outcome = lambda name, price: F.struct(F.lit(name).alias("name"), price.alias("price"))
    none = F.lit(None).cast("double")

    def bookmaker(b: Column) -> Column:
        away = F.when(b["book"] % 10 != 0, b["away_decimal_odds"]).otherwise(none)
        market = F.struct(F.lit("h2h").alias("key"), F.array(outcome("Home", b["home_decimal_odds"]), outcome("Away", away)).alias("outcomes"))
        other = F.struct(F.lit("spread").alias("key"), F.array(outcome("Home", F.lit(1.01))).alias("outcomes"))
        return F.struct(text(b["book"]).alias("key"), F.array(market, other).alias("markets"))

    # one payload per event with all its books, of which only the numbers are shuffled; every thirteenth payload is cut short
    numbers = F.collect_list(F.struct("book", "home_decimal_odds", "away_decimal_odds"))
    books = t.book_odds().groupBy("event_id").agg(numbers.alias("numbers")).select("event_id", F.transform("numbers", bookmaker).alias("books"))
    event = F.struct(
        text("event_id").alias("id"), F.lit("Home").alias("home_team"), F.lit("Away").alias("away_team"),
        F.lit("2024-01-01T00:00:00Z").alias("commence_time"), F.col("books").alias("bookmakers"))
    whole = F.to_json(F.array(event))
    landed = books.select(F.when(F.col("event_id") % 13 == 0, F.substring(whole, 1, 30)).otherwise(whole).alias("payload"))
    return L.book_odds(landed).select("event_id", "book", r6("home_decimal_odds"), r6("away_decimal_odds"), "problem")


@query("s11_market_quotes", with_ctes(f"""
SELECT quote_id::VARCHAR AS market_id, {q6('yes_price')} AS yes_price, CASE WHEN quote_id % 6 = 0 THEN 0.0 ELSE {q6('no_price')} END AS no_price FROM quotes"""))
def _(t: Tables) -> DataFrame:
    cents = F.col("quote_id") % 2 == 0
    none = F.lit(None).cast("double")
    ask = lambda c: F.when(cents, F.col(c) * 100).otherwise(F.col(c))
    # a cent quote of exactly one would read as a dollar, so such prices stay in dollars
    yes = F.when(F.col("yes_price") <= 0.011, F.col("yes_price")).otherwise(ask("yes_price"))
    no = F.when(F.col("quote_id") % 6 == 0, none).otherwise(F.when(F.col("no_price") <= 0.011, F.col("no_price")).otherwise(ask("no_price")))
    row = F.struct(text("quote_id").alias("id"), F.lit("TICK").alias("ticker"), F.lit("Title").alias("title"), yes.alias("yes_ask"), no.alias("no_ask"))
    landed = t.quotes().select(F.col("ts").alias("retrieved_at"), F.to_json(F.struct(F.array(row).alias("markets"))).alias("payload"))
    return L.market_quotes(landed).select("market_id", r6("yes_price"), r6("no_price"))


@query("s12_latest_snapshot", with_ctes(f"""
SELECT q.market_id, {qstamp('as_of')} AS as_of, {qstamp('max(s.ts)')} AS retrieved_at FROM (
  SELECT market_id, ts - INTERVAL 36 HOUR AS as_of FROM quotes) AS q LEFT JOIN quotes AS s ON s.market_id = q.market_id AND s.ts <= q.as_of GROUP BY q.market_id, as_of"""))
def _(t: Tables) -> DataFrame:
    snapshots = t.quotes().select(F.col("market_id").alias("query_key"), F.col("ts").alias("retrieved_at"), text("quote_id").alias("path"))
    asked = t.quotes().select(F.col("market_id").alias("query_key"), (F.col("ts") - F.expr("INTERVAL 36 HOUR")).alias("as_of"))
    found, missing = L.latest_snapshots(asked, snapshots)
    both = found.drop("path").unionByName(missing, allowMissingColumns=True)
    return both.select(F.col("query_key").alias("market_id"), stamp("as_of"), stamp("retrieved_at"))


@query("s13_envelope_check", with_ctes("""
SELECT game_id, CASE WHEN game_id % 6 = 0 THEN 'missing source_url' WHEN game_id % 5 = 0 THEN 'unsupported version' WHEN game_id % 7 = 0 THEN 'invalid time'
  WHEN game_id % 9 = 0 THEN 'payload is not an object' WHEN game_id % 4 = 0 THEN 'checksum mismatch' END AS problem FROM games"""))
def _(t: Tables) -> DataFrame:
    gid = F.col("game_id")
    body = F.when(gid % 9 == 0, F.lit("[1]")).otherwise(F.to_json(F.struct("game_id", "home_score")))
    df = t.games().withColumn("payload", body).select(
        "game_id", "payload",
        F.when(gid % 6 != 0, F.lit("https://feed.example/")).alias("source_url"),
        F.when(gid % 5 == 0, "scoreboard-v0").otherwise("scoreboard-v1").alias("normalization_version"),
        F.when(gid % 7 == 0, "2024-01-05T10:00:00").otherwise("2024-01-05T10:00:00+00:00").alias("retrieved_at"),
        F.sha2(F.when(gid % 4 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")), 256).alias("payload_sha256"))
    return L.verify_envelopes(df, "scoreboard-v1").select("game_id", "problem")


@query("s14_backfill_report", with_ctes("""
SELECT g.game_id, count(s.game_id) AS statlines FROM test_games AS g LEFT JOIN statlines AS s ON s.game_id = g.game_id GROUP BY g.game_id"""))
def _(t: Tables) -> DataFrame:
    return C.backfill_report(t.games(), t.statlines()).select("game_id", "statlines")


@query("s15_open_game_reports", with_ctes("""
SELECT report_id, r.game_id FROM (SELECT *, report_id AS game_id FROM reports) AS r JOIN games AS g ON g.game_id = r.game_id WHERE g.season_type = 'regular' AND NOT g.completed"""))
def _(t: Tables) -> DataFrame:
    return C.open_game_reports(t.reports().withColumn("game_id", F.col("report_id")), t.games()).select("report_id", "game_id")


@query("v1_validation", with_ctes("""
SELECT game_id, concat_ws(',', CASE WHEN season_year < 1999 THEN 'season_year' END, CASE WHEN game_id % 8 = 0 THEN 'season_type' END, CASE WHEN w NOT BETWEEN 1 AND 25 THEN 'week' END,
       CASE WHEN hs < 0 THEN 'scores' END, CASE WHEN completed AND hs IS NULL THEN 'completion' END) AS violations
FROM (SELECT *, week + game_id % 3 AS w, CASE WHEN game_id % 12 = 0 THEN NULL WHEN game_id % 10 = 0 THEN -1 ELSE home_score END AS hs FROM games) AS g"""))
def _(t: Tables) -> DataFrame:
    gid = F.col("game_id")
    score = F.when(gid % 12 == 0, None).when(gid % 10 == 0, -1).otherwise(F.col("home_score"))
    broken = t.games().withColumns({
        "season_year": F.col("season_year") + 1, "week": (F.col("week") + gid % 3).cast("int"), "home_score": score,
        "season_type": F.when(gid % 8 == 0, "friendly").otherwise(F.col("season_type"))})
    return C.with_violations(broken, C.game_rules()).select("game_id", F.array_join("violations", ",").alias("violations"))


# One rule after another is broken at every fifth, sixth, ... game: rule -> (column, a good value, a bad one).
BROKEN = {
    "team": {"abbreviation": ("abbreviation", "'ABC'", "'A'"), "display_name": ("display_name", "'Team'", "' '")},
    "team_strength_snapshot": {
        "season_year": ("season_year", "2020", "1999"), "through_week": ("through_week", "3", "26"), "games_played": ("games_played", "2", "-1"),
        "points": ("points_for", "40", "-3"), "exponent": ("exponent", "2.37", "0.0"), "strength": ("strength", "0.5", "1.5"),
    },
    "kalshi_event": {"ticker": ("ticker", "'T'", "''"), "title": ("title", "'t'", "NULL"), "scheduled_at": ("scheduled_at", "kickoff_at", "NULL"), "settlement_source": ("settlement_source", "'s'", "' '")},
    "kalshi_market": {
        "ticker": ("ticker", "'T'", "''"), "title": ("title", "'t'", "NULL"), "open_at": ("open_at", "kickoff_at", "NULL"), "close_at": ("close_at", "kickoff_at", "NULL"),
        "fee_type": ("fee_type", "'f'", "''"), "rules_primary": ("rules_primary", "'r'", "''"),
    },
    "orderbook_snapshot": {
        "observed_at": ("observed_at", "kickoff_at", "NULL"),
        "yes_bids": ("yes_bids", "array(named_struct('price_dollars', 0.4, 'contracts', 10.0))", "array(named_struct('price_dollars', 1.2, 'contracts', 10.0))"),
        "no_bids": ("no_bids", "array(named_struct('price_dollars', 0.4, 'contracts', 1.0))", "array(named_struct('price_dollars', 0.4, 'contracts', 0.0))"),
    },
    "forecast": {
        "probability": ("home_win_probability", "0.5", "NULL"), "probability_sum": ("tie_probability", "0.1", "0.9"), "uncertainty": ("uncertainty", "0.2", "-0.1"),
        "training_window": ("training_window_start", "kickoff_at", "kickoff_at + INTERVAL 1 DAY"),
    },
    "match_decision": {"decision_at": ("decision_at", "kickoff_at", "NULL"), "status": ("status", "'eligible'", "'maybe'"), "reason": ("reason", "'r'", "''")},
    "paper_recommendation": {"side": ("side", "'yes'", "'both'"), "entry_price": ("entry_price_dollars", "0.4", "1.4"), "max_loss": ("max_loss_dollars", "5.0", "0.0")},
    "outcome": {"settled_at": ("settled_at", "kickoff_at", "NULL"), "scores": ("home_score", "20", "-1"), "payout": ("market_payout_dollars", "1.0", "2.0")},
    "availability_report": {
        "player_id": ("player_id", "'p'", "' '"), "report_class": ("report_class", "'injury_status'", "'rumour'"), "status_text": ("status_text", "'Out'", "''"),
        "source_confidence": ("source_confidence", "0.9", "-0.5"), "correction_state": ("correction_state", "'original'", "'undone'"),
    },
    "player_game_statline": {
        "player_id": ("player_id", "'p'", "NULL"), "category": ("stat_category", "'passing'", "''"), "labels": ("stat_labels", "array('YDS')", "array()"),
        "lengths": ("stat_values", "array('1')", "array('1', '2')"),
    },
}
_FIXED = {"team_strength_snapshot": {"points_against": "30"}, "forecast": {"feature_cutoff_at": "kickoff_at"}, "outcome": {"away_score": "17"}}
# a bad value may break a second rule with it
_ALSO = {("forecast", "probability_sum"): "game_id % 5 = 0 OR game_id % 6 = 0", ("player_game_statline", "lengths"): "(game_id % 7 = 0) OR (game_id % 8 = 0)"}


def _validated(entity: str) -> None:
    rules = BROKEN[entity]
    where = {rule: _ALSO.get((entity, rule), f"game_id % {5 + i} = 0") for i, rule in enumerate(rules)}
    cases = ", ".join(f"CASE WHEN {cond} THEN '{rule}' END" for rule, cond in where.items())

    @query(f"v1_{entity}", with_ctes(f"SELECT game_id, concat_ws(',', {cases}) AS violations FROM games"))
    def _(t: Tables) -> DataFrame:
        own = [F.expr(f"CASE WHEN game_id % {5 + i} = 0 THEN {bad} ELSE {good} END").alias(c) for i, (c, good, bad) in enumerate(rules.values())]
        fixed = [F.expr(v).alias(c) for c, v in _FIXED.get(entity, {}).items()]
        rows = t.games().select("game_id", "kickoff_at", *[c for c in own], *fixed)
        return C.with_violations(rows, C.entity_rules(entity)).select("game_id", F.array_join("violations", ",").alias("violations"))


for _entity in BROKEN:
    _validated(_entity)


@query("v1_record", with_ctes("""
SELECT game_id, concat_ws(',', CASE WHEN game_id % 5 = 0 THEN 'id' END, CASE WHEN game_id % 6 = 0 OR game_id % 7 = 0 THEN 'provider_ids' END,
  CASE WHEN game_id % 8 = 0 THEN 'event_time' END, CASE WHEN game_id % 9 = 0 THEN 'schema_version' END) AS violations FROM games"""))
def _(t: Tables) -> DataFrame:
    gid = F.col("game_id")
    key = F.when(gid % 6 == 0, "my_password").otherwise("feed")
    rows = t.games().select(
        "game_id", F.when(gid % 5 == 0, "game:1").otherwise(C.record_key("game", F.lit("feed"), gid)).alias("id"),
        F.create_map(key, F.when(gid % 7 == 0, " ").otherwise(text(gid))).alias("provider_ids"),
        F.when(gid % 8 != 0, F.col("kickoff_at")).alias("event_time"), F.col("kickoff_at").alias("retrieved_at"),
        F.when(gid % 9 == 0, "0.1.0").otherwise(K.SCHEMA_VERSION).alias("schema_version"))
    return C.with_violations(rows, C.record_rules()).select("game_id", F.array_join("violations", ",").alias("violations"))


@query("s3_publish_and_read", with_ctes("""
SELECT 'team:' || substr(sha256('team' || chr(30) || 'feed' || chr(31) || (CASE WHEN game_id % 7 = 0 THEN -game_id - 1 ELSE game_id END)::VARCHAR), 1, 32) AS id,
       CASE WHEN game_id % 7 <> 0 THEN 'T' || home_team_id END AS abbreviation, game_id % 7 <> 0 AS found FROM games"""))
def _(t: Tables) -> DataFrame:
    gid = F.col("game_id")
    stamp_ = F.col("kickoff_at").cast("timestamp")
    rows = t.games().select(
        F.lit("team").alias("entity_type"), C.record_key("team", F.lit("feed"), gid).alias("id"), F.create_map(F.lit("feed"), text(gid)).alias("provider_ids"),
        stamp_.alias("event_time"), stamp_.alias("retrieved_at"), F.array().cast("array<" + S.SNAPSHOT_REF + ">").alias("source_snapshots"),
        F.lit(K.SCHEMA_VERSION).alias("schema_version"), F.concat(F.lit("T"), text("home_team_id")).alias("abbreviation"), F.lit("Team").alias("display_name"))
    root = stage_path(t.spark)
    store.publish(rows, root, "team", "1")
    asked = t.games().select(C.record_key("team", F.lit("feed"), F.when(gid % 7 == 0, -gid - 1).otherwise(gid)).alias("id"))
    found, missing = store.read_by_id(store.load_table(t.spark, root, "team", "1"), asked)
    return found.select("id", "abbreviation", F.lit(True).alias("found")).unionByName(
        missing.select("id", F.lit(None).cast("string").alias("abbreviation"), F.lit(False).alias("found")))


@query("v2_secret_screen", with_ctes("""
SELECT event_id, (event_id % 3 = 0) AS bad_url, (event_id % 4 = 0) AS bad_key FROM events"""))
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    url = F.concat(F.lit("https://feed.example/?"), F.when(i % 3 == 0, "Api_Key=").otherwise("page="), text("event_id"))
    keys = F.create_map(F.when(i % 4 == 0, "my_Password").otherwise("feed"), text("event_id"))
    return t.source("events").select("event_id", L.has_sensitive_word(url).alias("bad_url"), L.has_sensitive_key(keys).alias("bad_key"))


cte("asked_games", """
SELECT season_year AS requested, * FROM games WHERE season_type = 'regular' OR week = 1
UNION ALL SELECT season_year AS requested, * FROM games WHERE week = 2 AND season_type = 'regular'
UNION ALL SELECT season_year + 1 AS requested, * FROM games WHERE week = 25 AND season_type = 'regular'""")


@query("v3_season_coverage", with_ctes("""
SELECT requested::BIGINT AS requested_season, count(*) FILTER (WHERE fits AND k = 1) AS games_captured, count(*) FILTER (WHERE fits AND k > 1) AS duplicates,
       count(*) FILTER (WHERE NOT fits) AS inconsistent, count(*) FILTER (WHERE fits AND k = 1 AND NOT completed) AS incomplete,
       (SELECT count(DISTINCT team_id) FROM season_teams AS s WHERE s.season_year = requested) AS teams_captured, false AS is_complete
FROM (SELECT *, season_year = requested AND season_type = 'regular' AS fits,
             row_number() OVER (PARTITION BY requested, game_id, season_year = requested AND season_type = 'regular') AS k FROM asked_games) AS a GROUP BY requested"""))
def _(t: Tables) -> DataFrame:
    g = t.games().withColumn("event_id", F.col("game_id")).withColumn("retrieved_at", F.col("kickoff_at"))
    own = g.withColumn("requested_season", F.col("season_year"))
    regular = F.col("season_type") == "regular"
    asked = own.filter(regular | (F.col("week") == 1)).unionByName(own.filter(regular & (F.col("week") == 2))).unionByName(
        g.withColumn("requested_season", F.col("season_year") + 1).filter(regular & (F.col("week") == 25)))
    got = C.season_coverage(C.season_events(asked))
    return got.select(
        big("requested_season"), *[big(c) for c in ("games_captured", "duplicates", "inconsistent", "incomplete", "teams_captured")], "is_complete")


@query("v4_canonical_teams", with_ctes("""
SELECT 'team:' || substr(sha256('team' || chr(30) || 'feed' || chr(31) || t.team_id::VARCHAR), 1, 32) AS id, abbreviation, display_name FROM teams AS t
WHERE EXISTS (SELECT 1 FROM landed_games AS g WHERE g.problem IS NULL AND t.team_id IN (g.home_team_id, g.away_team_id))"""))
def _(t: Tables) -> DataFrame:
    return C.canonical_teams(normalized_games(t), "feed").select("id", "abbreviation", "display_name")


@query("v4_canonical_games", with_ctes("""
SELECT 'game:' || substr(sha256('game' || chr(30) || 'feed' || chr(31) || game_id::VARCHAR), 1, 32) AS id, season_year::BIGINT + 10 AS season_year,
       'team:' || substr(sha256('team' || chr(30) || 'feed' || chr(31) || home_team_id::VARCHAR), 1, 32) AS home_team_id, home_score::BIGINT AS home_score
FROM landed_games WHERE problem IS NULL"""))
def _(t: Tables) -> DataFrame:
    return C.canonical_games(normalized_games(t), "feed").select("id", big("season_year"), "home_team_id", big("home_score"))


@query("v5_test_games", with_ctes("SELECT game_id, season_year::BIGINT AS season_year FROM test_games WHERE season_year IN (1999, 2000)"))
def _(t: Tables) -> DataFrame:
    from gridcast.operators.sides import select_test_games

    return select_test_games(t.games(), [1999, 2000]).select("game_id", big("season_year"))
