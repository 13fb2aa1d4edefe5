"""Odds payloads are parsed once, and events do not travel with each of their books."""

from pyspark.sql import functions as F

from gridcast.sources import landed


def test_a_payload_is_parsed_once(spark):
    prices = '{"markets": [{"key": "h2h", "outcomes": [{"name": "H", "price": 1.5}, {"name": "A", "price": 2.5}]}], "key": "%s"}'
    event = '{"id": "%s", "home_team": "H", "away_team": "A", "commence_time": "2024-01-01T00:00:00Z", "bookmakers": %s}'
    payloads = [
        "[" + event % ("1", "[" + prices % "x" + ", null, " + prices % "y" + "]") + "]", "[" + event % ("2", "[]") + "]", "[" + event % ("3", "null") + "]",
        "[null, " + event % ("4", '[{"key": "z"}]') + "]", "[]", "[{", None,
    ]
    rows = landed.book_odds(spark.createDataFrame([(p,) for p in payloads], "payload string"))
    found = rows.select("event_id", "book", "home_team", "home_decimal_odds", "away_decimal_odds", "problem").collect()
    bad = ("", "", None, None, None, "events")
    assert sorted(map(tuple, found), key=repr) == sorted([("1", "x", "H", 1.5, 2.5, None), ("1", "y", "H", 1.5, 2.5, None), ("4", "z", "H", None, None, "prices"), bad, bad], key=repr)
    files = rows.select(F.count("*"), F.sum("home_decimal_odds"))  # what is asked for does not matter
    for frame in (rows, files):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
