"""Fits, resampling, ingestion, storage and streaming on small tables."""

import hashlib
import json
import math
import os
import random
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridcast.operators import availability as A
from gridcast import constants as K
from gridcast.operators import fitting, forecast, metrics, players, resample, season, signals
from gridcast.operators.availability import status_of_text
from gridcast.sources import bucketed, canonical, landed, store
from gridcast.streaming import ingest


def test_exponent_is_recovered(spark):
    rows = [(float(pf), float(pa), pf**2.6 / (pf**2.6 + pa**2.6)) for pf, pa in ((400, 300), (350, 350), (300, 400), (450, 250), (280, 420), (380, 310))]
    best, error = fitting.fit_exponent(spark.createDataFrame(rows, "points_for double, points_against double, win_rate double"))
    assert best == pytest.approx(2.6, abs=1e-3) and error < 1e-8
    with pytest.raises(ValueError):
        fitting.fit_exponent(spark.createDataFrame([(0.0, 0.0, 0.5), (0.0, 1.0, None), (None, 3.0, 0.2)], "points_for double, points_against double, win_rate double"))
    with pytest.raises(ValueError):
        fitting.fit_exponent(spark.createDataFrame(rows[:1], "points_for double, points_against double, win_rate double"))


def test_platt_recovers_its_slope(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        p = rng.uniform(0.05, 0.95)
        true = 1 / (1 + math.exp(-2.0 * math.log(p / (1 - p))))
        rows.append((p, int(rng.random() < true)))
    a, b = fitting.fit_platt(spark.createDataFrame(rows, "p double, home_won int"))
    assert a == pytest.approx(0.0, abs=0.2) and b == pytest.approx(2.0, abs=0.3)


def test_overlapping_folds_are_refused(spark):
    with pytest.raises(ValueError):
        fitting.select_exponent(spark.range(1), [2.0], [2000, 2001], [2001])


SAMPLES = "game_id long, p double, home_won int, is_tie boolean, reason string"


def test_scores(spark):
    rows = [(1, 0.8, 1, False, None), (2, 0.5, 0, False, None), (3, 0.7, 1, False, None), (4, 0.6, None, True, None), (5, None, 1, False, K.NO_HISTORY)]
    got = metrics.score(spark.createDataFrame(rows, SAMPLES)).first()
    assert got["brier"] == pytest.approx(0.38 / 3)
    assert (got["sample_count"], got["excluded_count"]) == (3, 2)
    half = spark.createDataFrame([(1, 0.5, 1, False, None)], SAMPLES)
    assert metrics.score(half).first()["log_loss"] == pytest.approx(-math.log(0.5))
    kept = {r["excluded"]: r["n"] for r in metrics.exclusion_counts(spark.createDataFrame(rows, SAMPLES)).collect()}
    assert kept == {"tie": 1, K.NO_HISTORY: 1}


def scored(spark, n=500):
    rng = random.Random(2)
    return spark.createDataFrame([("m", i, rng.random()) for i in range(n)], "model string, game_id long, loss double")


def test_resampling_does_not_depend_on_partitions(spark):
    results = []
    try:
        for parts in (1, 8, 50):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = scored(spark).repartition(parts)
            interval = resample.bootstrap_interval(df, "game_id", ["model"], ["loss"], 100).first()
            kept = sorted(r["game_id"] for r in resample.holdout(df, "game_id", ["model"]).select("game_id").collect())
            results.append((round(interval["loss_low"], 9), round(interval["loss_high"], 9), kept))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert results[0] == results[1] == results[2]
    low, high, kept = results[0]
    mean = scored(spark).agg(F.avg("loss")).first()[0]
    assert low < mean < high and len(kept) == 300


def test_holdout_rounds_half_to_even(spark):
    assert resample.holdout(scored(spark, 5), "game_id", ["model"], 0.5).count() == 2
    with pytest.raises(ValueError):
        resample.holdout(scored(spark, 5), "game_id", ["model"], 0.0)


def test_bootstrap_needs_two_samples(spark):
    assert resample.bootstrap_interval(scored(spark, 1), "game_id", ["model"], ["loss"], 10).count() == 0


def test_trial_draws_do_not_depend_on_partitions(spark):
    rows = [(i, 2020, i % 5, 5 + i % 5, 0.1 + (i % 9) / 10) for i in range(60)]
    df = spark.createDataFrame(rows, "game_id long, season_year int, home_team_id int, away_team_id int, p double")
    draw = lambda n: sorted(tuple(r) for r in season.trial_outcomes(df.repartition(n), 20).select("game_id", "trial", "winner_id").collect())
    assert draw(1) == draw(8)
    rate = season.trial_outcomes(df.filter("p > 0.45 and p < 0.55"), 2000).agg(F.avg((F.col("winner_id") == F.col("home_team_id")).cast("int"))).first()[0]
    assert rate == pytest.approx(0.5, abs=0.02)


def test_ranking_uses_head_to_head_for_two(spark):
    records = spark.createDataFrame([(2020, 0, 1, 0.5), (2020, 0, 2, 0.5), (2020, 0, 3, 0.9)], "season_year int, trial int, team_id int, win_rate double").withColumn("g", F.lit("x"))
    left = spark.createDataFrame([], "season_year int, game_id long, home_team_id int, away_team_id int, p double, kickoff_at timestamp")
    met = spark.createDataFrame([(2020, 1, 2, 2)], "season_year int, low_id int, high_id int, winner_id int")
    got = {r["team_id"]: r["place"] for r in season.rank_with_tiebreak(records, left, met, ["g"], "x").collect()}
    assert got == {3: 1, 2: 2, 1: 3}


def test_unknown_division_is_reported(spark):
    known, unknown = season.attach_divisions(spark.createDataFrame([(1, "KC"), (2, "ZZZ")], "team_id int, abbreviation string"))
    assert known.first()["division"] == "West" and unknown.first()["team_id"] == 2


def test_production_skips_unreadable_text(spark):
    rows = [("passing", ["C/ATT", "YDS", "TD", "INT"], ["14/19", "250", "2", "1"]), ("passing", ["YDS", "TD"], ["-", "1"]), ("fumbles", ["LOST"], ["1"]), ("kicking", ["FG", "XP"], ["2", "3"])]
    df = spark.createDataFrame(rows, "c string, l array<string>, v array<string>")
    got = [r[0] for r in df.select(players.production(F.col("c"), F.col("l"), F.col("v"))).collect()]
    assert got == pytest.approx([16.0, 4.0, 0.0, 9.0])


def test_status_texts(spark):
    rows = [("injury_status", " OUT "), ("injury_status", "maybe"), ("in_game_incident", "questionable to return"), ("in_game_incident", "has returned"), ("in_game_incident", "left game"), ("roster_status", "active")]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, t string").select(status_of_text(F.col("c"), F.col("t"))).collect()]
    assert got == ["out", None, "tentative", "returned", "left_game", None]


def test_backtest_equals_the_sequential_one(spark):
    bets = [(1, 0.6, 2.0), (0, 0.6, 2.0), (1, 0.3, 2.0), (1, 0.5, 3.0)]
    bank = 10000.0
    for won, p, odds in bets:
        if p > 1 / odds:
            bank += bank * 0.01 * (odds - 1) if won else -bank * 0.01
    got = signals.binary_backtest(spark.createDataFrame(bets, "outcome int, win_probability double, decimal_odds double").withColumn("s", F.lit("x")), ["s"]).first()
    assert (got["trades"], got["wins"], got["losses"]) == (3, 2, 1)
    assert got["ending_bankroll"] == pytest.approx(round(bank, 2))


# --- landing ------------------------------------------------------------------------------


def team(i):
    return {"id": str(i), "abbreviation": f"T{i}", "displayName": f"Team {i}"}


def event(eid="1", **change):
    comp = {
        "neutralSite": False,
        "status": {"type": {"name": "final", "completed": True}},
        "competitors": [{"homeAway": "home", "score": "20", "team": team(1)}, {"homeAway": "away", "score": "17", "team": team(2)}],
    }
    base = {"id": eid, "date": "2025-09-08T00:20Z", "season": {"year": 2025, "type": 2}, "week": {"number": 1}, "competitions": [comp]}
    return base | change


def test_scoreboard_payloads(spark):
    bad = event("2")
    bad["competitions"][0]["competitors"][0]["score"] = "seven"
    twice = event("3")
    twice["competitions"][0]["competitors"].append({"homeAway": "home", "score": "1", "team": team(3)})
    early = event("4")
    early["competitions"][0]["status"]["type"]["completed"] = False
    for c in early["competitions"][0]["competitors"]:
        del c["score"]
    none = event("5")
    del none["competitions"][0]["competitors"][1]["score"]
    events = [event(), bad, twice, early, none, event("6", season={"year": 2025, "type": 7}), event("7", date="2025-09-08 00:20"), event("8", week={})]
    df = spark.createDataFrame([(json.dumps({"events": events}),)], "payload string")
    got = {r["event_id"]: r for r in landed.scoreboard_games(df).collect()}
    assert [got[str(i)]["problem"] for i in range(1, 9)] == [None, "score", "competitors", None, "missing score", "season type", "kickoff", "week"]
    assert (got["1"]["home_score"], got["1"]["away_score"], got["1"]["kickoff_at"]) == (20, 17, datetime(2025, 9, 8, 0, 20))
    assert got["4"]["home_score"] is None and got["4"]["completed"] is False


def test_flags_spelled_as_text_and_unreadable_payloads(spark):
    texts = event("1")
    texts["competitions"][0]["status"]["type"]["completed"] = "true"
    site = event("2")
    site["competitions"][0]["neutralSite"] = "false"
    payloads = [json.dumps({"events": [texts, site, event("3")]}), "{\"events\": [", "{}", json.dumps({"events": "x"}), json.dumps({"events": []})]
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    got = sorted(((r["event_id"], r["problem"]) for r in landed.scoreboard_games(df).collect()), key=repr)
    assert got == sorted([("1", "completed"), ("2", "neutral site"), ("3", None), (None, "events"), (None, "events"), (None, "events")], key=repr)
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(["{", "{}", '{"boxscore": 5, "injuries": "x"}', '{"boxscore": null, "injuries": null}', '{"boxscore": {"players": null}, "injuries": []}', '{"boxscore": {}}'])], "event_id string, payload string")
    assert sorted((r["event_id"], r["problem"]) for r in landed.boxscore_statlines(df).collect()) == [(i, "box score") for i in "0125"]
    assert sorted((r["event_id"], r["problem"]) for r in landed.injury_reports(df).collect()) == [(i, "injuries") for i in "0125"]
    odds = spark.createDataFrame([("[",), ("[]",), ('[{"id": "a", "home_team": "H", "bookmakers": [{"key": "k", "markets": []}]}]',)], "payload string")
    assert sorted(r["problem"] for r in landed.book_odds(odds).collect()) == ["events", "prices"]
    quotes = spark.createDataFrame([("{",), ('{"markets": []}',), ('{"markets": [{"id": "m", "yes_ask": 45}]}',)], "payload string").selectExpr("*", "current_timestamp() AS retrieved_at")
    assert sorted((r["market_id"], r["problem"]) for r in landed.market_quotes(quotes).collect()) == [("", "markets"), ("m", None)]


def test_conflicts_inside_a_batch(spark):
    when = datetime(2025, 1, 1)
    schema = "provider string, source_url string, retrieved_at timestamp, payload string"
    batch = spark.createDataFrame([("feed", "https://a/", when, "{}"), ("feed", "https://b/", when, "{}"), ("feed", "https://c/", when, "{1}"), ("feed", "https://c/", when, "{1}")], schema)
    stored = landed.snapshot_identity(batch.limit(0))
    fresh, rejected = landed.append_snapshots(stored, batch)
    assert [r["source_url"] for r in fresh.collect()] == ["https://c/"]
    assert sorted((r["source_url"], r["problem"]) for r in rejected.collect()) == [("https://a/", "conflicting content"), ("https://b/", "conflicting content")]


def test_checksums_tell_nulls_and_separators_apart(spark):
    frame = lambda *rows: metrics.fingerprint(spark.createDataFrame(list(rows), "a string, b string, c string"), ["a", "b", "c"]).first()["checksum"]
    assert len({frame(("1", None, "2")), frame(("1", "2", None)), frame(("1|2", None, None)), frame(("", None, "12"))}) == 4


def test_summary_payloads(spark):
    def block(i, athletes):
        return {"team": team(i), "statistics": [{"name": "passing", "labels": ["C/ATT", "YDS"], "athletes": athletes}, {"name": "empty", "labels": [], "athletes": []}]}

    who = lambda i: {"id": str(i), "displayName": f"P{i}"}
    good = {"boxscore": {"players": [block(1, [{"athlete": who(1), "stats": ["1/2", "30"]}, {"athlete": who(2), "stats": ["0/1", "0"]}]), block(2, [{"athlete": who(3), "stats": ["1/1", "5"]}])]},
            "injuries": [{"team": team(1), "injuries": [{"status": "Out", "date": "2025-09-08T10:00Z", "athlete": who(4) | {"position": {"abbreviation": "QB"}}}]}, {"team": team(2), "injuries": []}]}
    broken = {"boxscore": {"players": [block(1, [{"athlete": who(1), "stats": ["1/2", "30"]}, {"athlete": {"displayName": "x"}, "stats": ["1", "2"]}])]}, "injuries": None}
    upcoming = {"boxscore": {"players": None}, "injuries": None}
    df = spark.createDataFrame([("a", json.dumps(good)), ("b", json.dumps(broken)), ("c", json.dumps(upcoming))], "event_id string, payload string")
    lines = landed.boxscore_statlines(df)
    accepted, quarantine = landed.split_events(lines)
    assert sorted((r["event_id"], r["athlete_id"]) for r in accepted.collect()) == [("a", "1"), ("a", "2"), ("a", "3")]
    assert [(r["event_id"], r["problem"]) for r in quarantine.collect()] == [("b", "athlete")]
    injury = landed.injury_reports(df).collect()
    assert [(r["event_id"], r["athlete_id"], r["position"], r["problem"]) for r in injury] == [("a", "4", "QB", None)]


def test_keys_and_rules(spark):
    df = spark.createDataFrame([("x", "1"), ("x", " ")], "a string, b string")
    keys = [r[0] for r in df.select(canonical.record_key("Game", F.col("a"), F.col("b"))).collect()]
    assert keys[1] is None and len(keys[0]) == len("game:") + 32 and keys[0].startswith("game:")
    urls = spark.createDataFrame([("https://a/?API_KEY=1",), ("https://a/?page=1",)], "u string")
    assert [r[0] for r in urls.select(landed.has_sensitive_word(F.col("u"))).collect()] == [True, False]


def test_publish_and_load(spark, tmp_path):
    rows = [("team", f"team:{i:032x}", {"feed": str(i)}, datetime(2025, 1, 1), datetime(2025, 1, 1), [], K.SCHEMA_VERSION, f"T{i}", f"Team {i}") for i in range(20)]
    from gridcast.sources.schemas import schema_of

    df = spark.createDataFrame(rows, schema_of("team"))
    store.publish(df, str(tmp_path), "team", "1")
    back = store.load_table(spark, str(tmp_path), "team", "1")
    assert back.count() == 20 and back.schema == schema_of("team")
    assert store.load_table(spark, str(tmp_path), "game", None).count() == 0
    with pytest.raises(Exception):
        store.publish(df, str(tmp_path), "team", "1")


def test_stream_of_snapshots(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def land(name, events, broken=False, at="2025-09-08T10:00:00+00:00"):
        payload = json.dumps({"events": events})
        digest = hashlib.sha256((payload + ("x" if broken else "")).encode()).hexdigest()
        line = {"normalization_version": "v1", "source_url": "https://feed.example/", "retrieved_at": at, "payload_sha256": digest, "payload": payload}
        (src / name).write_text(json.dumps(line) + "\n")

    land("a.json", [event("1"), event("2", week={})])
    land("b.json", [event("1"), event("2", week={})])  # the same snapshot again
    land("c.json", [event("9")], broken=True)
    land("d.json", [event("5")], at="2025-08-19T10:00:00+00:00")  # a backfill of snapshots twenty days older
    (src / "e.json").write_text(json.dumps({"normalization_version": "v1", "payload": "{}"}) + "\n")
    out, bad, checkpoint = str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / uuid.uuid4().hex)

    def run():
        rows = ingest.game_rows(ingest.landed_stream(spark, str(src), 1), "v1")
        q = ingest.write_games(rows, out, bad, checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r["event_id"] for r in spark.read.parquet(out).collect()), sorted(str(r["problem"]) for r in spark.read.parquet(bad).collect())

    problems = ["checksum mismatch", "missing source_url", "week"]
    assert run() == (["1", "5"], problems)
    # Restarted: a repeated snapshot, a late one, and both kinds of rejects again.
    land("f.json", [event("1"), event("2", week={})])
    land("g.json", [event("7")], at="2025-08-01T10:00:00+00:00")
    land("h.json", [event("9")], broken=True)
    assert run() == (["1", "5", "7"], problems)
    # The driver is lost after a batch was written, before it was marked as done: the batch runs again.
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    os.remove(f"{checkpoint}/commits/{last}")
    if os.path.exists(f"{checkpoint}/commits/.{last}.crc"):
        os.remove(f"{checkpoint}/commits/.{last}.crc")
    assert run() == (["1", "5", "7"], problems)


def test_stream_fails_on_what_it_cannot_read(spark, tmp_path):
    """A fault in the sink ends the stream; it does not let snapshots through unseen."""
    (tmp_path / "in").mkdir()
    (tmp_path / "out").write_text("a file where a folder should be")
    payload = json.dumps({"events": [event("1")]})
    line = {"normalization_version": "v1", "source_url": "u", "retrieved_at": "2025-09-08T10:00:00+00:00", "payload_sha256": hashlib.sha256(payload.encode()).hexdigest(), "payload": payload}
    (tmp_path / "in" / "a.json").write_text(json.dumps(line))
    rows = ingest.game_rows(ingest.landed_stream(spark, str(tmp_path / "in"), 1), "v1")
    q = ingest.write_games(rows, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(Exception):
        q.awaitTermination(120)


def test_bucketed_table(spark, tmp_path):
    root, schema = str(tmp_path), "id string, retrieved_at long, value string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    kind = frame([]).schema
    look = lambda version=None: {r["id"]: r["value"] for r in bucketed.read_table(spark, root, kind, version).collect()}
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("data/**/*.parquet")}
    assert look() == {} and bucketed.read_keys(spark, root, kind, frame([("a", 1, "x")])).count() == 0
    assert bucketed.merge(spark, root, frame([]), buckets=8).number == 0
    first = bucketed.merge(spark, root, frame([(f"k{i}", 5, f"v{i}") for i in range(200)]), buckets=8)
    assert (first.number, len(first.folders), look()) == (1, 8, {f"k{i}": f"v{i}" for i in range(200)})
    before = files()
    second = bucketed.merge(spark, root, frame([("k3", 1, "old"), ("k3", 2, "new"), ("k3", None, "none"), ("fresh", 1, "f")]), buckets=99)
    changed = {b for b in second.folders if second.folders[b] != first.folders[b]}
    asked = {r[0] for r in frame([("k3", 1, ""), ("fresh", 1, "")]).select(bucketed.bucket_of(F.col("id"), 8)).collect()}
    assert second.buckets == 8 and changed == asked and before.items() <= files().items()
    assert all(any(f"{f}/" in p for p in before) for b, f in second.folders.items() if b not in changed)
    assert look() == {f"k{i}": f"v{i}" for i in range(200)} | {"k3": "new", "fresh": "f"}
    assert look(1)["k3"] == "v3" and "fresh" not in look(1)
    table = bucketed.read_keys(spark, root, kind, frame([("k3", 0, ""), ("nobody", 0, "")]))
    assert [(r["id"], r["value"]) for r in table.collect()] == [("k3", "new")]
    assert {f.rsplit("/", 2)[1] for f in table.inputFiles() if "bucket=" in f} <= {f"bucket={b}" for b in range(8) if b in {r[0] for r in frame([("k3", 0, ""), ("nobody", 0, "")]).select(bucketed.bucket_of(F.col("id"), 8)).collect()}}
    with pytest.raises(ValueError, match="no version 9"):
        look(9)


def test_two_writers_of_one_version(spark, tmp_path):
    root, rows = str(tmp_path), spark.createDataFrame([("a", 1, "x")], "id string, retrieved_at long, value string")
    bucketed.merge(spark, root, rows)
    (tmp_path / "manifest" / "version=2").mkdir()  # another writer is at it
    (tmp_path / "manifest" / "version=2" / "_temporary").mkdir()
    with pytest.raises(Exception):
        bucketed.merge(spark, root, rows.withColumn("value", F.lit("y")))
    assert [r["value"] for r in bucketed.read_table(spark, root, rows.schema, 1).collect()] == ["x"]


def test_season_gate(spark):
    rows = [(2020, str(i), 2020, "regular", i % 4, 4 + i % 4, True, datetime(2020, 9, 1)) for i in range(8)]
    schema = "requested_season int, event_id string, season_year int, season_type string, home_team_id int, away_team_id int, completed boolean, retrieved_at timestamp"
    gate = lambda rows: canonical.season_coverage(canonical.season_events(spark.createDataFrame(rows, schema)), True, 8, 8).first()
    assert gate(rows)["is_complete"]
    more = rows + [rows[0], (2020, "x", 2019, "regular", 1, 2, True, datetime(2020, 9, 1))]
    got = gate(more)
    assert (got["duplicates"], got["inconsistent"], got["games_captured"], got["is_complete"]) == (1, 1, 8, False)
    late = gate(rows[:-1] + [rows[-1][:6] + (False,) + rows[-1][7:]])
    assert (late["incomplete"], late["is_complete"]) == (1, False)
    events = canonical.season_events(spark.createDataFrame(more, schema))
    assert sorted(r["problem"] for r in canonical.season_problems(events).collect()) == ["duplicate", "inconsistent"]
    assert canonical.accepted_games(events).count() == 8


def test_game_delta_tells_abstained_from_nobody_missing(spark):
    rows = [(1, True, 0.05, None), (1, False, None, "MissingReplacementError"), (2, True, None, "InsufficientHistoryError")]
    impacts = spark.createDataFrame(rows, "game_id long, is_home boolean, mean_impact double, abstain_reason string")
    found = {r["game_id"]: (r["injury_delta"], r["players_out"], r["players_abstained"]) for r in players.game_delta(impacts).collect()}
    assert found == {1: (-0.05, 1, 1), 2: (None, None, 1)}


def test_no_task_orders_a_whole_axis(spark):
    """The places on a team-season's axis come from sums in two levels; what is ordered by team and season alone are totals of its weeks."""
    when = lambda i: datetime(2020, 9, 1 + i % 28, i % 24)
    probes = spark.createDataFrame([(1, 2020, when(i)) for i in range(200)], "team_id int, season_year int, cutoff timestamp")
    lines = [(1, 2020, p, "passing", when(i), float(p + i % 3)) for p in range(5) for i in range(0, 200, 7)]
    scored = spark.createDataFrame(lines, "team_id int, season_year int, player_id int, category string, kickoff_at timestamp, score double")
    chart = players.depth_chart(probes, scored)
    totals = {}
    for r in chart.collect():
        totals.setdefault(r["cutoff"], {})[r["place"]] = r["player_id"]
    for cutoff in {p[2] for p in [(1, 2020, when(i)) for i in range(200)]}:
        mine = {}
        for _, _, player, _, at, score in lines:
            if at < cutoff:
                mine[player] = mine.get(player, 0.0) + score
        order = sorted(mine, key=lambda p: (-round(mine[p], 6), p))[:2]
        assert [totals.get(cutoff, {}).get(i) for i in range(1, len(order) + 1)] == order


def test_report_positions_and_contributing_reports(spark):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [
        (1, 7, "practice", at(1), at(3)), (2, 7, "practice", at(2), at(2)), (3, 7, "practice", at(3), at(3)),
        (4, 7, "official", at(9), at(9)), (5, 8, "practice", at(1), at(1)),
    ]
    reports = spark.createDataFrame(rows, "report_id int, player_id int, report_class string, event_time string, retrieved_at string")
    reports = reports.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("event_time", "retrieved_at")}).withColumn("correction_state", F.lit("original"))
    reports = reports.withColumn("status_text", F.lit("out"))
    placed = A.report_positions(A.live_reports(reports), ["player_id", "report_class"])
    # visible at 2, then twice at 3: the tie goes to the smaller id
    assert {(r["report_id"], r["position"]) for r in placed.collect()} == {(2, 1), (1, 2), (3, 3), (4, 1), (5, 1)}
    asked = spark.createDataFrame([(7, at(2), "practice", 1), (7, at(5), "practice", 3), (9, at(5), None, 0)], "player_id int, as_of string, report_class string, reports long")
    listed = {(r["player_id"], r["as_of"]): r["report_ids"] for r in A.with_report_ids(asked, reports).collect()}
    assert listed == {(7, at(2)): [2], (7, at(5)): [1, 2, 3], (9, at(5)): []}
    decisions = spark.createDataFrame([(7, at(1)), (7, at(3)), (9, at(3))], "player_id int, as_of string").withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))
    seen = {(r["player_id"], r["as_of"].hour): r["reports"] for r in A.visible_prefix(decisions, reports).collect()}
    assert seen == {(7, 1): 0, (7, 3): 3, (9, 3): 0}


def test_forecast_record_with_injury_step(spark):
    rows = [
        (1, "2024-01-01 00:00:00", False, None, 0.6, 0.55, -0.05, ["a", "b"]),
        (2, "2024-01-01 00:00:00", False, None, 0.6, 0.6, None, None),
        (3, "2024-01-01 00:00:00", True, "none", None, None, None, None),
    ]
    made = spark.createDataFrame(
        rows, "game_id int, cutoff string, abstained boolean, abstain_reason string, home_win_probability double, adjusted_probability double, "
        "injury_delta double, adjusted_players array<string>",
    ).withColumns({c: F.lit(3) for c in ("home_cur_n", "away_cur_n")} | {c: F.lit(0.5) for c in ("home_shrink_weight", "away_shrink_weight", "uncertainty")})
    made = made.withColumns({"training_window_start": F.col("cutoff"), "home_field_applied": F.lit(True)})
    by_id = {r["game_id"]: r for r in forecast.forecast_record(made).collect()}
    assert [by_id[i]["home_win_probability"] for i in (1, 2, 3)] == [0.55, 0.6, None]
    assert [by_id[i]["injury_adjustment"] for i in (1, 2, 3)] == [-0.05, 0.0, None]
    assert [by_id[i]["adjusted_players"] for i in (1, 2, 3)] == [["a", "b"], [], None]
    assert by_id[1]["tie_probability"] == 0.0 and len({r["id"] for r in by_id.values()}) == 3
    plain = forecast.forecast_record(made.drop("injury_delta", "adjusted_players", "adjusted_probability")).filter("game_id = 1").first()
    assert plain["id"] == by_id[1]["id"] and plain["home_win_probability"] == 0.6 and plain["adjusted_players"] == []
