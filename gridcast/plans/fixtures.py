"""Game, statline, report, quote and odds tables derived from the given order and event tables.

The given tables hold no games, so each view reads a sporting meaning into them:
an order is a game, a line item a player's stat line, an event an availability
report or a market quote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.session import intact, stage

ABBREVIATIONS = list(K.DIVISIONS)


_STAGED: dict[tuple[str, ...], DataFrame] = {}


class Tables:
    """Mapped views over one data folder.

    ``games`` and ``statlines`` stand for the stored canonical tables every job
    starts from, so they are written once per session and then only read; they are
    written again where their files have gone since.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name, self._state())
        if key not in _STAGED or not intact(_STAGED[key]):
            _STAGED[key] = stage(build())
        return _STAGED[key]

    def _state(self) -> str:
        """Size and time of the files the stored tables are made of, so that new files are not taken for the old ones."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = files.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return "|".join(sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in system.listStatus(files)))

    def games(self) -> DataFrame:
        return self._stored("games", self.map_games)

    def statlines(self) -> DataFrame:
        return self._stored("statlines", self.map_statlines)

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def map_games(self) -> DataFrame:
        odd = F.col("l_linenumber") % 2 == 1
        lines = (
            self.source("lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.min("l_suppkey").alias("first_supplier"),
                F.count(F.lit(1)).alias("lines"),
                F.sum(F.when(odd, F.col("l_quantity")).otherwise(0.0)).cast("bigint").alias("home_points"),
                F.sum(F.when(odd, 0.0).otherwise(F.col("l_quantity"))).cast("bigint").alias("away_points"),
            )
        )
        home = self.source("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home_team_id")
        )
        away = self.source("supplier").select(
            F.col("s_suppkey").alias("first_supplier"), F.col("s_nationkey").alias("away_team_id")
        )
        done = F.col("lines") >= 2
        return (
            self.source("orders")
            .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
            .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
            .join(home, "o_custkey")
            .join(away, "first_supplier")
            .filter(F.col("home_team_id") != F.col("away_team_id"))
            .select(
                F.col("o_orderkey").alias("game_id"),
                F.year("o_orderdate").alias("season_year"),
                F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "preseason").otherwise("regular").alias("season_type"),
                (F.floor((F.dayofyear("o_orderdate") - 1) / 15) + 1).cast("int").alias("week"),
                F.col("o_orderdate").alias("kickoff_at"),
                "home_team_id",
                "away_team_id",
                F.when(done, F.col("home_points")).alias("home_score"),
                F.when(done, F.col("away_points")).alias("away_score"),
                done.alias("completed"),
                (F.col("o_orderpriority") == "5-LOW").alias("neutral_site"),
            )
        )

    def teams(self) -> DataFrame:
        names = F.array(*[F.lit(a) for a in ABBREVIATIONS])
        return (
            self.source("nation")
            .join(self.source("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("n_nationkey").alias("team_id"),
                F.get(names, F.col("n_nationkey")).alias("abbreviation"),
                F.col("n_name").alias("display_name"),
                F.col("r_name").alias("region"),
            )
        )

    def map_statlines(self) -> DataFrame:
        hundredths = lambda c: F.floor(F.round(F.col(c) * 100)).cast("int")
        text = lambda c: c.cast("int").cast("string")
        yards = text(F.col("l_quantity") * 10)
        touchdowns = text(hundredths("l_tax"))
        lost = text(hundredths("l_discount") % 4)
        total = text(F.col("l_quantity"))
        attempts = F.concat(total, F.lit("/"), yards)
        shapes = {
            0: ("fumbles", ["FUM", "LOST"], [total, lost]),
            1: ("passing", ["C/ATT", "YDS", "TD", "INT"], [attempts, yards, touchdowns, lost]),
            2: ("rushing", ["CAR", "YDS", "TD"], [total, yards, touchdowns]),
            3: ("receiving", ["REC", "YDS", "TD"], [total, yards, touchdowns]),
            4: ("defensive", ["TOT", "SACKS", "TD"], [total, lost, touchdowns]),
        }
        kind = F.col("l_linenumber") % 5

        def pick(build) -> Column:
            out = None
            for k, shape in shapes.items():
                out = F.when(kind == k, build(shape)) if out is None else out.when(kind == k, build(shape))
            return out

        games = self.games().select("game_id", "home_team_id", "away_team_id")
        return (
            self.source("lineitem")
            .select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
            .join(games, F.col("l_orderkey") == F.col("game_id"))
            .select(
                "game_id",
                F.when(F.col("l_linenumber") % 2 == 1, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_id"),
                F.col("l_suppkey").alias("player_id"),
                F.col("l_linenumber").alias("line"),
                pick(lambda s: F.lit(s[0])).alias("stat_category"),
                pick(lambda s: F.array(*[F.lit(x) for x in s[1]])).alias("stat_labels"),
                pick(lambda s: F.array(*s[2])).alias("stat_values"),
            )
        )

    def reports(self) -> DataFrame:
        """Availability reports; text depends on class and value, source on the props counter."""
        texts = {
            "injury_status": ["Out", " doubtful ", "QUESTIONABLE", "day to day"],
            "practice_participation": [
                "Did Not Participate", "limited participation", "Full Participation", "resting",
            ],
            "gameday_inactive": ["Inactive", "active", "inactive", "INACTIVE"],
            "roster_status": ["Injured Reserve", "reserve/injured", "active", "Non-Football Injury"],
            "in_game_incident": ["left the game", "has returned", "questionable to return", "being evaluated"],
        }
        by_event = {
            "click": "injury_status", "view": "practice_participation", "purchase": "in_game_incident",
            "signup": "roster_status", "error": "gameday_inactive",
        }
        cls = text = None
        for event, name in by_event.items():
            hit = F.col("event_type") == event
            words = F.get(F.array(*[F.lit(t) for t in texts[name]]), (F.floor("value") % 4).cast("int"))
            cls = F.when(hit, name) if cls is None else cls.when(hit, name)
            text = F.when(hit, words) if text is None else text.when(hit, words)
        counter = F.get_json_object("props", "$.k").cast("int")
        return self.source("events").select(
            F.col("event_id").alias("report_id"),
            F.col("user_id").alias("player_id"),
            F.concat(F.lit("source-"), (counter % 3).cast("string")).alias("source"),
            cls.alias("report_class"),
            text.alias("status_text"),
            F.col("ts").alias("event_time"),
            (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 7).cast("int"))).alias("retrieved_at"),
            F.when(F.col("event_id") % 17 == 0, "retracted").otherwise("original").alias("correction_state"),
        )

    def season_reports(self) -> DataFrame:
        """The same reports moved into the 2000 season, a different month per player."""
        shift = F.make_dt_interval(days=(F.col("player_id") % 12 * 30 - 8766).cast("int"))
        reports = self.reports()
        return reports.withColumn("event_time", F.col("event_time") + shift).withColumn(
            "retrieved_at", F.col("retrieved_at") + shift
        )

    def quotes(self) -> DataFrame:
        yes = F.round(F.least(F.greatest(F.col("value") / (F.col("value") + 50), F.lit(0.01)), F.lit(0.99)), 4)
        return self.source("events").select(
            F.col("event_id").alias("quote_id"),
            F.col("user_id").alias("market_id"),
            F.col("ts"),
            yes.alias("yes_price"),
            F.round(F.lit(1.0) - yes, 4).alias("no_price"),
        )

    def book_odds(self) -> DataFrame:
        return self.source("lineitem").select(
            F.col("l_orderkey").alias("event_id"),
            F.col("l_suppkey").alias("book"),
            (F.lit(1.0) + F.col("l_quantity") / 40).alias("home_decimal_odds"),
            (F.lit(1.0) + (F.lit(51.0) - F.col("l_quantity")) / 40).alias("away_decimal_odds"),
        )
