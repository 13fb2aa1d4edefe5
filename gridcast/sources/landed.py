"""Landed snapshots: append, verify, pick the latest, and turn payloads into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.operators.asof import asof_aggregate
from gridcast.sources import schemas as S


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def first_problem(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that fails; null when all pass. A null check counts as failed."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def has_sensitive_word(text: Column) -> Column:
    return F.lower(text).rlike("|".join(K.SENSITIVE_WORDS))


def has_sensitive_key(provider_ids: Column) -> Column:
    return F.exists(F.map_keys(provider_ids), has_sensitive_word)


# --- raw snapshots ------------------------------------------------------------------


def snapshot_identity(batch: DataFrame) -> DataFrame:
    """Content hash and content-addressed path of each landed payload (provider, source_url, retrieved_at, payload)."""
    stamp = F.date_format("retrieved_at", "yyyyMMdd'T'HHmmssSSSSSS'Z'")
    day = F.date_format("retrieved_at", "yyyy-MM-dd")
    return batch.withColumn("sha256", F.sha2("payload", 256)).withColumn("retrieval_date", day).withColumn(
        "path", F.concat_ws("/", F.lit("raw"), F.col("provider"), day, F.concat(stamp, F.lit("-"), F.col("sha256"), F.lit(".json")))
    )


def append_snapshots(existing: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to add, and rejected rows with a problem.

    Landing the same content again adds nothing. The same path with another source
    is a conflict, as a kept snapshot never changes; inside a batch all its rows are refused, as none came first.
    """
    named = snapshot_identity(batch).dropDuplicates(["path", "source_url"])
    sources = named.groupBy("path").agg(F.count(F.lit(1)).alias("_sources"))
    known = existing.select("path", F.col("source_url").alias("_known_url"))
    checked = named.join(sources, "path").join(known, "path", "left").withColumn(
        "problem",
        first_problem(
            [
                ("provider name", ~F.col("provider").rlike("^[a-z][a-z0-9_-]*$")),
                ("sensitive url", has_sensitive_word(F.col("source_url"))),
                ("conflicting content", F.coalesce(F.col("_known_url") != F.col("source_url"), F.col("_sources") > 1)),
            ]
        ),
    ).drop("_sources")
    fresh = checked.filter(F.col("problem").isNull() & F.col("_known_url").isNull())
    return fresh.drop("problem", "_known_url"), checked.filter(F.col("problem").isNotNull()).drop("_known_url")


def verify_envelopes(envelopes: DataFrame, version: str) -> DataFrame:
    """Add ``problem`` to snapshot envelopes: missing fields, another version, a bad time or a wrong checksum."""
    required = ["normalization_version", "source_url", "retrieved_at", "payload_sha256", "payload"]
    when = F.try_to_timestamp("retrieved_at")
    return envelopes.withColumn(
        "problem",
        first_problem(
            [(f"missing {c}", F.col(c).isNull()) for c in required]
            + [
                ("unsupported version", F.col("normalization_version") != version),
                ("invalid time", when.isNull() | ~F.col("retrieved_at").rlike(r"(Z|[+-]\d\d:\d\d)$")),
                ("payload is not an object", ~F.ltrim("payload").startswith("{")),
                ("checksum mismatch", F.sha2("payload", 256) != F.col("payload_sha256")),
            ]
        ),
    )


def latest_snapshots(requests: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Newest snapshot of each (query_key, as_of) retrieved no later than ``as_of``, and the requests without one."""
    newest = asof_aggregate(
        requests, snapshots, ["query_key"], "retrieved_at",
        {"_newest": ("max", F.struct("retrieved_at", "path"))}, probe_ts="as_of", inclusive=True,
    )
    found = newest.filter(F.col("_newest").isNotNull()).select(
        "query_key", "as_of", F.col("_newest.retrieved_at").alias("retrieved_at"), F.col("_newest.path").alias("path")
    )
    return found, newest.filter(F.col("_newest").isNull()).select("query_key", "as_of")


# --- payloads to rows ------------------------------------------------------------------


def utc(text: Column) -> Column:
    """ISO time with a zone, seconds optional; null without a zone or when unreadable."""
    full = F.regexp_replace(text, r"T(\d\d:\d\d)(Z|[+-])", "T$1:00$2")
    return F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(full))


def _team(team: Column, prefix: str) -> list[Column]:
    return [
        team["id"].alias(f"{prefix}_id"), team["abbreviation"].alias(f"{prefix}_abbreviation"), team["displayName"].alias(f"{prefix}_name"),
    ]


def _bad_team(team: Column) -> Column:
    return team.isNull() | blank(team["id"]) | blank(team["abbreviation"]) | blank(team["displayName"])


def listed(parent: str, key: str, items: Column) -> Column:
    """Whether ``key`` of the JSON object at ``parent`` of the payload is there and is a list, or null outright.

    ``items`` is the parsed list. A payload that cannot be read, lacks the key or has something else there is not listed.
    """
    whole = F.get_json_object("payload", parent)
    there = F.array_contains(F.json_object_keys(whole), key)
    return items.isNotNull() | (F.coalesce(there, F.lit(False)) & F.get_json_object("payload", f"{parent}.{key}").isNull())


def scoreboard_games(snapshots: DataFrame) -> DataFrame:
    """One row per event of every scoreboard payload; ``problem`` names what keeps it from being a game.

    A payload without a readable list of events is one row with that problem.
    """
    parsed = snapshots.withColumn("_p", F.from_json("payload", S.SCOREBOARD)).withColumn("_none", F.col("_p.events").isNull())
    events = parsed.withColumn("_e", F.explode_outer("_p.events")).filter(F.col("_none") | (F.size("_p.events") > 0)).drop("_p", "payload")
    e = F.col("_e")
    source = F.try_element_at(e["competitions"], F.lit(1))
    events = events.withColumn("_text", source)
    comp = F.from_json("_text", S.COMPETITION)
    home = lambda c: c["homeAway"] == "home"
    away = lambda c: c["homeAway"] == "away"
    wide = events.withColumn("_comp", comp).withColumns(
        {
            "_homes": F.filter(F.col("_comp")["competitors"], home),
            "_aways": F.filter(F.col("_comp")["competitors"], away),
        }
    ).withColumn("_home", F.get("_homes", F.lit(0))).withColumn("_away", F.get("_aways", F.lit(0)))
    codes = F.create_map(*[F.lit(x) for pair in K.SEASON_TYPE_CODES.items() for x in pair])

    def score(side: str) -> Column:
        return F.col(side)["score"].try_cast("int")

    def unreadable(side: str) -> Column:
        text = F.col(side)["score"]
        return text.isNotNull() & (text != "") & score(side).isNull()

    done = F.col("_comp")["status"]["type"]["completed"]
    neutral = F.col("_comp")["neutralSite"]
    quoted = lambda name: F.coalesce(F.col("_text").rlike(f'"{name}"\\s*:\\s*"'), F.lit(False))
    season_type = F.try_element_at(codes, e["season"]["type"].cast("int"))
    problem = first_problem(
        [
            ("events", F.col("_none")),
            ("event id", blank(e["id"])),
            ("kickoff", utc(e["date"]).isNull()),
            ("competition count", F.coalesce(F.size(e["competitions"]), F.lit(0)) != 1),
            ("season", ~(e["season"]["year"] >= 2000)),
            ("season type", season_type.isNull()),
            ("week", ~e["week"]["number"].between(1, 25)),
            ("neutral site", quoted("neutralSite") | (neutral.isNotNull() & ~neutral.isin("true", "false"))),
            ("competitors", (F.size("_homes") != 1) | (F.size("_aways") != 1)),
            ("status", blank(F.col("_comp")["status"]["type"]["name"])),
            ("completed", quoted("completed") | ~F.coalesce(done.isin("true", "false"), F.lit(False))),
            ("score", unreadable("_home") | unreadable("_away")),
            ("negative score", (F.coalesce(score("_home"), F.lit(0)) < 0) | (F.coalesce(score("_away"), F.lit(0)) < 0)),
            ("missing score", (done == "true") & (score("_home").isNull() | score("_away").isNull())),
            ("team", _bad_team(F.col("_home")["team"]) | _bad_team(F.col("_away")["team"])),
        ]
    )
    keep = [c for c in snapshots.columns if c != "payload"]
    return wide.select(
        *keep,
        e["id"].alias("event_id"),
        e["season"]["year"].cast("int").alias("season_year"),
        season_type.alias("season_type"),
        e["week"]["number"].cast("int").alias("week"),
        utc(e["date"]).alias("kickoff_at"),
        F.col("_comp")["status"]["type"]["name"].alias("status"),
        (done == "true").alias("completed"),
        neutral.try_cast("boolean").alias("neutral_site"),
        *_team(F.col("_home")["team"], "home_team"),
        *_team(F.col("_away")["team"], "away_team"),
        score("_home").alias("home_score"),
        score("_away").alias("away_score"),
        problem.alias("problem"),
    )


def _bad_athlete(athlete: Column) -> Column:
    return athlete.isNull() | blank(athlete["id"]) | blank(athlete["displayName"])


def boxscore_statlines(summaries: DataFrame) -> DataFrame:
    """One row per team, category and athlete of every summary (event_id, payload); ``problem`` on bad rows.

    A game not played yet, whose box score or its list is null outright, has no row. A payload
    that cannot be read or lacks the list is one row with that problem.
    """
    parsed = summaries.withColumn("_p", F.from_json("payload", S.SUMMARY))
    keep = [c for c in summaries.columns if c != "payload"]
    there = listed("$.boxscore", "players", F.col("_p.boxscore.players")) | listed("$", "boxscore", F.col("_p.boxscore"))
    there = F.when(F.col("_p.boxscore").isNotNull(), listed("$.boxscore", "players", F.col("_p.boxscore.players"))).otherwise(there)
    teams = parsed.select(*keep, (~there).alias("_lost"), F.explode_outer("_p.boxscore.players").alias("_t")).filter(F.col("_lost") | F.col("_t").isNotNull())
    categories = teams.select(*keep, "_lost", "_t.team", F.explode_outer("_t.statistics").alias("_c"))
    lines = categories.select(*keep, "_lost", "team", "_c.name", "_c.labels", F.col("_c.athletes").isNull().alias("_none"), F.explode_outer("_c.athletes").alias("_a"))
    lines = lines.filter(F.col("_none") | F.col("_a").isNotNull())
    text = lambda a: F.forall(a, lambda v: v.isNotNull())
    return lines.select(
        *keep,
        *_team(F.col("team"), "team"),
        F.col("name").alias("stat_category"),
        F.col("labels").alias("stat_labels"),
        F.col("_a.athlete.id").alias("athlete_id"),
        F.col("_a.athlete.displayName").alias("athlete_name"),
        F.col("_a.stats").alias("stat_values"),
        first_problem(
            [
                ("box score", F.col("_lost")),
                ("team", _bad_team(F.col("team"))),
                ("category", blank(F.col("name"))),
                ("labels", ~text(F.col("labels"))),
                ("athletes", F.col("_none")),
                ("athlete", _bad_athlete(F.col("_a.athlete"))),
                ("stats", ~text(F.col("_a.stats"))),
                ("length", F.size("labels") != F.size("_a.stats")),
            ]
        ).alias("problem"),
    )


def injury_reports(summaries: DataFrame) -> DataFrame:
    """One row per listed injury of every summary; ``problem`` on bad rows.

    A list that is null outright has no row; a payload that cannot be read or lacks the list is one row with that problem.
    """
    parsed = summaries.withColumn("_p", F.from_json("payload", S.SUMMARY))
    keep = [c for c in summaries.columns if c != "payload"]
    there = listed("$", "injuries", F.col("_p.injuries"))
    teams = parsed.select(*keep, (~there).alias("_lost"), F.explode_outer("_p.injuries").alias("_t")).filter(F.col("_lost") | F.col("_t").isNotNull())
    rows = teams.select(*keep, "_lost", "_t.team", F.col("_t.injuries").isNull().alias("_none"), F.explode_outer("_t.injuries").alias("_i"))
    rows = rows.filter(F.col("_none") | F.col("_i").isNotNull())
    athlete = F.col("_i.athlete")
    place = F.coalesce(athlete["position"]["abbreviation"], athlete["position"]["displayName"])
    return rows.select(
        *keep,
        *_team(F.col("team"), "team"),
        athlete["id"].alias("athlete_id"),
        athlete["displayName"].alias("athlete_name"),
        F.when(~blank(place), place).alias("position"),
        F.col("_i.status").alias("status_text"),
        utc(F.col("_i.date")).alias("reported_at"),
        first_problem(
            [
                ("injuries", F.col("_lost")),
                ("team", _bad_team(F.col("team"))),
                ("list", F.col("_none")),
                ("athlete", _bad_athlete(athlete)),
                ("status", blank(F.col("_i.status"))),
                ("date", utc(F.col("_i.date")).isNull()),
            ]
        ).alias("problem"),
    )


def split_events(rows: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantine. One bad row keeps its whole event out, as a part of a box score is no box score."""
    bad = rows.filter(F.col("problem").isNotNull())
    good = rows.filter(F.col("problem").isNull()).join(bad.select(key).distinct(), key, "left_anti")
    return good.drop("problem"), bad


def book_odds(snapshots: DataFrame) -> DataFrame:
    """One row per event and book with both head-to-head prices, from the book's first market; ``problem`` on rows without them.

    A payload that is no list of events is one row with that problem. An event without books has no row.
    """
    # each list is used in one place, so a payload is parsed once, and no row carries the books of its event
    listed_events = F.transform(F.from_json("payload", S.ODDS), lambda e: F.struct(F.lit(False).alias("_none"), e.alias("_e")))
    unread = F.array(F.struct(F.lit(True).alias("_none"), F.lit(None).cast(S.ODDS.removeprefix("array<")[:-1]).alias("_e")))
    events = snapshots.select(F.inline(F.coalesce(listed_events, unread)))
    books = events.select("_none", *[F.col(f"_e.{c}").alias(c) for c in ("id", "home_team", "away_team", "commence_time")], F.explode_outer("_e.bookmakers").alias("_b"))
    books = books.filter("_none OR _b IS NOT NULL")
    outcomes = F.get(F.col("_b.markets"), F.lit(0))["outcomes"]
    home = F.col("home_team")
    last = lambda a: F.try_element_at(a, F.lit(-1))["price"]
    rows = books.select(
        F.coalesce("id", F.lit("")).alias("event_id"),
        home.alias("home_team"),
        F.coalesce("away_team", F.lit("")).alias("away_team"),
        utc(F.col("commence_time")).alias("commence_time"),
        F.coalesce("_b.key", F.lit("")).alias("book"),
        last(F.filter(outcomes, lambda o: o["name"] == home)).alias("home_decimal_odds"),
        last(F.filter(outcomes, lambda o: ~F.coalesce(o["name"] == home, F.lit(False)))).alias("away_decimal_odds"),
        "_none",
    )
    unpriced = ~F.coalesce((F.col("home_decimal_odds") != 0) & (F.col("away_decimal_odds") != 0), F.lit(False))
    return rows.withColumn("problem", first_problem([("events", F.col("_none")), ("prices", unpriced)])).drop("_none")


def market_quotes(snapshots: DataFrame) -> DataFrame:
    """One row per listed market; asks above one are cents. A payload without a readable list of markets is one row with that ``problem``."""
    parsed = snapshots.withColumn("_list", F.from_json("payload", S.MARKETS)["markets"]).withColumn("_none", F.col("_list").isNull())
    rows = parsed.withColumn("_m", F.explode_outer("_list")).filter(F.col("_none") | (F.size("_list") > 0))
    price = lambda c: F.when(F.col(c) > 1, F.col(c) / 100).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    return rows.select(
        F.coalesce("_m.id", F.lit("")).alias("market_id"),
        F.coalesce("_m.ticker", F.lit("")).alias("ticker"),
        F.coalesce("_m.title", F.lit("")).alias("title"),
        price("_m.yes_ask").alias("yes_price"),
        price("_m.no_ask").alias("no_price"),
        F.coalesce("_m.volume", F.lit(0.0)).alias("volume"),
        F.col("retrieved_at").alias("ts"),
        first_problem([("markets", F.col("_none"))]).alias("problem"),
    )
