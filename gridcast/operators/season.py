"""Projections over a schedule: win totals, standings and a trial-by-trial simulation as table jobs.

Every function takes games that carry ``as_of``, so several seasons (each with its
own date) are projected in one job. A game counts as played when completed and
kicked off before ``as_of``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast import constants as K
from gridcast.functions.draws import Draws, uniform
from gridcast.operators.forecast import baseline_forecast
from gridcast.session import spread, stage


def is_played() -> Column:
    return F.col("completed") & (F.col("kickoff_at") < F.col("as_of"))


def schedule(games: DataFrame) -> DataFrame:
    return games.filter(F.col("season_type") == "regular")


def remaining_probabilities(games: DataFrame, history: DataFrame) -> DataFrame:
    """Home-win probability of every unplayed game at ``as_of``; even where no forecast can be made."""
    left = schedule(games).filter(~is_played()).withColumn("cutoff", F.col("as_of"))
    return baseline_forecast(left, history).select(
        "game_id", "season_year", "week", "kickoff_at", "home_team_id", "away_team_id",
        F.coalesce("home_win_probability", F.lit(0.5)).alias("p"),
    )


def _both_sides(df: DataFrame, home: dict[str, Column], away: dict[str, Column]) -> DataFrame:
    side = lambda parts: F.struct(*[c.alias(n) for n, c in parts.items()])
    return df.withColumn("_side", F.explode(F.array(side(home), side(away)))).select("season_year", "_side.*")


def played_sides(games: DataFrame) -> DataFrame:
    """Win, loss and tie flags of both sides of every played game."""
    home, away = F.coalesce("home_score", F.lit(0)), F.coalesce("away_score", F.lit(0))
    flag = lambda c: c.cast("bigint")
    return _both_sides(
        schedule(games).filter(is_played()),
        {"team_id": F.col("home_team_id"), "won": flag(home > away), "lost": flag(home < away), "tied": flag(home == away)},
        {"team_id": F.col("away_team_id"), "won": flag(away > home), "lost": flag(away < home), "tied": flag(home == away)},
    )


def win_rate(wins: Column, losses: Column, ties: Column) -> Column:
    played = wins + losses + ties
    return F.when(played > 0, (wins + F.lit(0.5) * ties) / played).otherwise(F.lit(0.0))


def standings(games: DataFrame) -> DataFrame:
    """Record of every team of the season from its played games; teams without one have an empty record."""
    teams = season_teams(games)
    done = played_sides(games).groupBy("season_year", "team_id").agg(
        F.sum("won").alias("wins"), F.sum("lost").alias("losses"), F.sum("tied").alias("ties")
    )
    df = teams.join(done, ["season_year", "team_id"], "left").fillna(0, ["wins", "losses", "ties"])
    return df.withColumn("win_rate", win_rate(F.col("wins"), F.col("losses"), F.col("ties")))


def season_teams(games: DataFrame) -> DataFrame:
    return (
        schedule(games)
        .select("season_year", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
        .distinct()
    )


def _with_pair(df: DataFrame) -> DataFrame:
    return df.withColumn("low_id", F.least("home_team_id", "away_team_id")).withColumn(
        "high_id", F.greatest("home_team_id", "away_team_id")
    )


def head_to_head(games: DataFrame) -> DataFrame:
    """Winner of the latest played meeting of every pair; null when it was a tie."""
    winner = F.when(F.col("home_score") > F.col("away_score"), F.col("home_team_id")).when(
        F.col("home_score") < F.col("away_score"), F.col("away_team_id")
    )
    return (
        _with_pair(schedule(games).filter(is_played()))
        .groupBy("season_year", "low_id", "high_id")
        .agg(F.max_by(F.struct(winner.alias("winner_id")), F.struct("kickoff_at", "game_id")).alias("_last"))
        .select("season_year", "low_id", "high_id", F.col("_last.winner_id").alias("winner_id"))
    )


def win_totals(games: DataFrame, history: DataFrame) -> DataFrame:
    """Wins so far plus the sum of remaining win probabilities, with a one-deviation band.

    The band comes from the exact variance of independent games and stays between
    the wins already made and winning out.
    """
    won = played_sides(games).groupBy("season_year", "team_id").agg(
        F.count(F.lit(1)).alias("games_played"), F.sum(F.col("won") + F.lit(K.TIE_WIN_VALUE) * F.col("tied")).alias("wins_so_far")
    )
    ahead = _both_sides(
        remaining_probabilities(games, history),
        {"team_id": F.col("home_team_id"), "p": F.col("p")},
        {"team_id": F.col("away_team_id"), "p": 1 - F.col("p")},
    ).groupBy("season_year", "team_id").agg(
        F.count(F.lit(1)).alias("games_remaining"),
        F.sum("p").alias("expected_additional_wins"),
        F.sum(F.col("p") * (1 - F.col("p"))).alias("win_variance"),
    )
    df = (
        season_teams(games)
        .join(won, ["season_year", "team_id"], "left")
        .join(ahead, ["season_year", "team_id"], "left")
        .fillna(0, ["games_played", "games_remaining"])
        .fillna(0.0, ["wins_so_far", "expected_additional_wins", "win_variance"])
    )
    total = F.col("wins_so_far") + F.col("expected_additional_wins")
    reach = F.lit(K.CONFIDENCE_BAND_Z) * F.sqrt("win_variance")
    return df.withColumns(
        {
            "expected_total_wins": total,
            "band_low": F.greatest(F.col("wins_so_far"), total - reach),
            "band_high": F.least(F.col("wins_so_far") + F.col("games_remaining"), total + reach),
        }
    )


# --- trials ---------------------------------------------------------------------------


def _trials(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


#: Groups a task holds sums or hits of before it sends them on.
_GROUPS = 1000


def _packed(trials: int, seed: int):
    """mapInArrow: append to each game the bits of the trials its home side wins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = Draws(seed, range(trials))
        for batch in batches:
            names = [n.encode() for n in batch.column("_name").to_pylist()]
            # an unknown chance is not met
            chances = batch.column("p").cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)
            bits: list = [None] * batch.num_rows
            for at, hit in draws.below(names, chances):
                for i, packed in zip(at.tolist(), np.packbits(hit, axis=1), strict=True):
                    bits[i] = packed.tobytes()
            kept = [n for n in batch.schema.names if n != "_name"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(bits, pa.binary())], [*kept, "home_wins"])

    return run


def trial_outcomes(remaining: DataFrame, trials: int = K.SEASON_TRIALS, seed: int = K.SEED, packed: bool = False) -> DataFrame:
    """One row per remaining game and trial with its drawn winner, or if ``packed`` one per game, with the trials its home side wins as bits in ``home_wins``.

    The bits hold the same draws. They are what :func:`trial_records` adds up, as records of games times trials are too many.
    """
    if packed:
        named = spread(remaining, "game_id").withColumn("_name", F.col("game_id").cast("string"))
        schema = T.StructType([*remaining.schema.fields, T.StructField("home_wins", T.BinaryType())])
        return named.mapInArrow(_packed(trials, seed), schema)
    home = uniform(seed, F.col("trial"), F.col("game_id")) < F.col("p")
    return (
        spread(remaining, "game_id")
        .withColumn("trial", _trials(trials))
        .withColumn("winner_id", F.when(home, F.col("home_team_id")).otherwise(F.col("away_team_id")))
        .withColumn("loser_id", F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")))
    )


def _bit_rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for bits in batch.column("home_wins").to_pylist():
        yield np.frombuffer(bits, np.uint8)


def _team_wins(trials: int):
    """mapInArrow: games with bits, or sums of other tasks, to the games of each team and its wins in every trial."""

    def records(sums: dict) -> pa.RecordBatch:
        keys, held = list(sums), list(sums.values())
        ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * trials)
        return pa.RecordBatch.from_arrays(
            [*[pa.array([k[i] for k in keys], kinds[i]) for i in range(2)], pa.array([n for n, _ in held], pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate([w for _, w in held]))],
            ["season_year", "team_id", "_n", "_won"],
        )

    kinds: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def add(key: tuple, games: int, won: np.ndarray) -> None:
            if key not in sums:
                sums[key] = [0, np.zeros(trials, np.int64)]
            sums[key][0] += games
            np.add(sums[key][1], won, out=sums[key][1])

        for batch in batches:
            summed = "team_id" in batch.schema.names
            teams = ["team_id"] if summed else ["home_team_id", "away_team_id"]
            kinds[:] = [batch.column(n).type for n in ("season_year", teams[0])]
            keys = list(zip(*[batch.column(n).to_pylist() for n in ("season_year", *teams)], strict=True))
            if summed:
                flat = batch.column("_won").flatten().to_numpy(zero_copy_only=False).reshape(-1, trials)
                for key, games, won in zip(keys, batch.column("_n").to_pylist(), flat, strict=True):
                    add(key, games, won)
            else:
                for (season, home, away), bits in zip(keys, _bit_rows(batch), strict=True):
                    won = np.unpackbits(bits, count=trials)
                    add((season, home), 1, won)
                    add((season, away), 1, 1 - won)
            if len(sums) > _GROUPS:
                yield records(sums)
                sums.clear()
        if sums:
            yield records(sums)

    return run


def _drawn_records(outcomes: DataFrame, trials: int) -> DataFrame:
    """Games and wins of every (season, trial, team) among the drawn games. What leaves a task is an array of wins for each of its teams."""
    if "home_wins" in outcomes.columns:
        kinds = {f.name: f.dataType for f in outcomes.schema.fields}
        schema = T.StructType([
            T.StructField("season_year", kinds["season_year"]), T.StructField("team_id", kinds["home_team_id"]),
            T.StructField("_n", T.LongType()), T.StructField("_won", T.ArrayType(T.LongType())),
        ])
        sides = outcomes.select("season_year", "home_team_id", F.col("away_team_id").cast(kinds["home_team_id"]), "home_wins")
        sums = sides.mapInArrow(_team_wins(trials), schema).repartition("season_year", "team_id").mapInArrow(_team_wins(trials), schema)
        each = sums.select("season_year", "team_id", "_n", F.posexplode("_won").alias("trial", "_w"))
        return each.groupBy("season_year", "trial", "team_id").agg(F.sum("_w").alias("_won"), F.sum("_n").alias("_n"))
    return (
        outcomes.withColumn(
            "_side",
            F.explode(
                F.array(
                    F.struct(F.col("winner_id").alias("team_id"), F.lit(1).alias("w")),
                    F.struct(F.col("loser_id").alias("team_id"), F.lit(0).alias("w")),
                )
            ),
        )
        .groupBy("season_year", "trial", "_side.team_id")
        .agg(F.sum("_side.w").alias("_won"), F.count(F.lit(1)).alias("_n"))
    )


def trial_records(outcomes: DataFrame, base: DataFrame, trials: int = K.SEASON_TRIALS) -> DataFrame:
    """Final record of every team in every trial: played games plus drawn ones.

    Drawn games are summed per (trial, team) on the map side, so what is shuffled
    grows with teams and trials and not with games.
    """
    drawn = _drawn_records(outcomes, trials)
    df = base.withColumn("trial", _trials(trials)).join(drawn, ["season_year", "trial", "team_id"], "left").fillna(0, ["_won", "_n"])
    df = df.withColumn("wins", F.col("wins") + F.col("_won")).withColumn("losses", F.col("losses") + F.col("_n") - F.col("_won"))
    return df.drop("_won", "_n").withColumn("win_rate", win_rate(F.col("wins"), F.col("losses"), F.col("ties")))


def _set_hits(trials: int):
    """mapInArrow: picked games with bits, or the words of other tasks, to the trials in which all picks of a set come true, as whole numbers of 64 bits."""
    words = -(-trials // 64)
    every = np.packbits(np.arange(words * 64) < trials).view(np.int64)

    def records(hits: dict, kind: pa.DataType) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(hits) + 1, dtype=np.int32) * words)
        return pa.RecordBatch.from_arrays([pa.array(list(hits), kind), pa.ListArray.from_arrays(ends, np.concatenate(list(hits.values())))], ["set_id", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: dict = {}
        for batch in batches:
            sets, kind = batch.column("set_id").to_pylist(), batch.column("set_id").type
            if "words" in batch.schema.names:
                rows = batch.column("words").flatten().to_numpy(zero_copy_only=False).reshape(-1, words)
            else:
                home, away = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_home", "_away"))
                rows = np.zeros((batch.num_rows, words * 8), np.uint8)
                for i, bits in enumerate(_bit_rows(batch)):
                    rows[i, : len(bits)] = (bits if home[i] else 0) | (~bits if away[i] else 0)
                rows = rows.view(np.int64)
            for key, row in zip(sets, rows, strict=True):
                if key not in hits:
                    hits[key] = every.copy()
                np.bitwise_and(hits[key], row, out=hits[key])
            if len(hits) > 10 * _GROUPS:
                yield records(hits, kind)
                hits.clear()
        if hits:
            yield records(hits, kind)

    return run


def _joint_hits(outcomes: DataFrame, trials: int) -> DataFrame:
    """Per set the number of trials in which all its picks come true. ``outcomes`` are packed, with set_id and picked_id."""
    # a side that cannot be compared with the pick rules nothing out, as a null is not looked at by a minimum
    right = lambda side: F.coalesce(F.col(side) == F.col("picked_id"), F.lit(True))
    schema = T.StructType([T.StructField("set_id", outcomes.schema["set_id"].dataType), T.StructField("words", T.ArrayType(T.LongType()))])
    picked = outcomes.select("set_id", "home_wins", right("home_team_id").alias("_home"), right("away_team_id").alias("_away"))
    parts = picked.mapInArrow(_set_hits(trials), schema).repartition("set_id").mapInArrow(_set_hits(trials), schema)
    words = parts.select("set_id", F.posexplode("words").alias("_at", "_word")).groupBy("set_id", "_at").agg(F.bit_and("_word").alias("_word"))
    return words.groupBy("set_id").agg(F.sum(F.bit_count("_word").cast("bigint")).alias("hits"))


def rank_with_tiebreak(
    records: DataFrame, remaining: DataFrame, played_h2h: DataFrame, group: Sequence[str], label: str, seed: int = K.SEED
) -> DataFrame:
    """Place of every team in its group per trial: win rate, then head to head for a tie of two, else a draw.

    Which meeting of two teams is the last does not depend on the trial. So the remaining games are reduced to
    the last one per pair, and its winner is drawn where the pair is in fact tied, with the draw
    that :func:`trial_outcomes` makes for that game and trial.
    """
    where = ["season_year", "trial", *group]
    tie = Window.partitionBy(*where, "win_rate")
    tied = (
        records.withColumn("_size", F.count(F.lit(1)).over(tie))
        .withColumn("low_id", F.min("team_id").over(tie))
        .withColumn("high_id", F.max("team_id").over(tie))
    )
    game = F.struct("game_id", "home_team_id", "away_team_id", "p")
    last = _with_pair(remaining).groupBy("season_year", "low_id", "high_id").agg(F.max_by(game, F.struct("kickoff_at", "game_id")).alias("_last"))
    known = tied.join(last, ["season_year", "low_id", "high_id"], "left").join(played_h2h, ["season_year", "low_id", "high_id"], "left")
    home = uniform(seed, F.col("trial"), F.col("_last.game_id")) < F.col("_last.p")
    drawn = F.when(F.col("_last").isNotNull(), F.when(home, F.col("_last.home_team_id")).otherwise(F.col("_last.away_team_id")))
    better = F.coalesce(drawn, "winner_id")
    lot = uniform(seed, F.lit(label), F.col("trial"), F.col("team_id"))
    key = F.when((F.col("_size") == 2) & better.isNotNull(), (F.col("team_id") != better).cast("double")).otherwise(lot)
    order = Window.partitionBy(*where).orderBy(F.col("win_rate").desc(), F.col("_key"), F.col("team_id"))
    return known.withColumn("_key", key).withColumn("place", F.row_number().over(order)).drop(
        "_size", "low_id", "high_id", "_last", "winner_id", "_key"
    )


def attach_divisions(teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Teams with conference and division, and apart from them the teams whose abbreviation is not known."""
    table = F.create_map(
        *chain.from_iterable(
            (F.lit(a), F.struct(F.lit(c).alias("conference"), F.lit(d).alias("division"))) for a, (c, d) in K.DIVISIONS.items()
        )
    )
    found = teams.withColumn("_place", F.try_element_at(table, F.col("abbreviation")))
    known = found.filter(F.col("_place").isNotNull()).select(*teams.columns, "_place.*")
    return known, found.filter(F.col("_place").isNull()).drop("_place")


def playoff_field(
    records: DataFrame, remaining: DataFrame, played_h2h: DataFrame, teams: DataFrame,
    wildcards: int = K.WILDCARDS_PER_CONFERENCE, seed: int = K.SEED,
) -> DataFrame:
    """Division winners and wildcards of every trial. A team without a division is an error, not a gap."""
    known, unknown = attach_divisions(teams)
    lost = records.filter("trial = 0").select("team_id").distinct().join(known, "team_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no known division for team {lost[0]['team_id']}")
    placed = records.join(known.select("team_id", "conference", "division"), "team_id")
    first = stage(rank_with_tiebreak(placed, remaining, played_h2h, ["conference", "division"], "division", seed)).withColumn(
        "division_winner", F.col("place") == 1
    ).drop("place")
    rest = rank_with_tiebreak(first.filter(~F.col("division_winner")), remaining, played_h2h, ["conference"], "wildcard", seed)
    return (
        first.filter("division_winner")
        .withColumn("playoffs", F.lit(True))
        .unionByName(rest.withColumn("playoffs", F.col("place") <= wildcards).drop("place"))
    )


def simulation_summary(field: DataFrame, trials: int = K.SEASON_TRIALS, percents: Sequence[int] = (10, 25, 50, 75, 90)) -> DataFrame:
    """Win-total percentiles (nearest rank), mean, division and playoff rate per team.

    Percentiles are read off the histogram of totals, which has as many rows as
    there are different totals, so no list of trials is sorted.
    """
    total = F.col("wins") + F.lit(0.5) * F.col("ties")
    per_total = field.withColumn("total", total).groupBy("season_year", "team_id", "total").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("division_winner").cast("bigint")).alias("_division"),
        F.sum(F.col("playoffs").cast("bigint")).alias("_playoffs"),
    )
    upto = Window.partitionBy("season_year", "team_id").orderBy("total").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = per_total.withColumn("_upto", F.sum("_n").over(upto))
    index = lambda pct: int(round((trials - 1) * pct / 100))
    return counted.groupBy("season_year", "team_id").agg(
        *[F.min(F.when(F.col("_upto") > index(p), F.col("total"))).alias(f"p{p}") for p in percents],
        (F.sum(F.col("total") * F.col("_n")) / F.sum("_n")).alias("mean_wins"),
        (F.sum("_division") / F.lit(trials)).alias("division_rate"),
        (F.sum("_playoffs") / F.lit(trials)).alias("playoff_rate"),
    )


def combined_outcomes(
    picks: DataFrame, games: DataFrame, history: DataFrame, trials: int = K.SEASON_TRIALS, seed: int = K.SEED
) -> DataFrame:
    """Chance that all picks of a set come true together, with fair odds and the exact product.

    ``picks`` has set_id, game_id and winner_id. A played game that went the other
    way makes the set impossible. Unplayed picks use the same draws as the season
    simulation.
    """
    listed = picks.join(games.select("game_id", "season_year", "completed", "kickoff_at", "as_of", "home_team_id", "away_team_id", "home_score", "away_score"), "game_id")
    actual = F.when(F.col("home_score") > F.col("away_score"), F.col("home_team_id")).when(
        F.col("home_score") < F.col("away_score"), F.col("away_team_id")
    )
    done = listed.filter(is_played()).groupBy("set_id").agg(
        F.sum((~F.coalesce(actual == F.col("winner_id"), F.lit(False))).cast("bigint")).alias("missed")
    )
    ahead = listed.filter(~is_played()).select("set_id", "game_id", F.col("winner_id").alias("picked_id"))
    remaining = stage(
        remaining_probabilities(games.join(ahead.select("game_id").distinct(), "game_id", "left_semi"), history).join(ahead, "game_id")
    )
    joint = _joint_hits(trial_outcomes(remaining, trials, seed, packed=True), trials)
    chance = F.when(F.col("picked_id") == F.col("home_team_id"), F.col("p")).otherwise(1 - F.col("p"))
    exact = remaining.groupBy("set_id").agg(F.product(chance).alias("product"))
    sets = picks.select("set_id").distinct().join(done, "set_id", "left").join(joint, "set_id", "left").join(exact, "set_id", "left")
    possible = F.coalesce("missed", F.lit(0)) == 0
    p = F.when(possible, F.coalesce("hits", F.lit(trials)) / F.lit(trials)).otherwise(F.lit(0.0))
    return sets.withColumn("joint_probability", p).select(
        "set_id", "joint_probability",
        F.when(F.col("joint_probability") > 0, 1 / F.col("joint_probability")).alias("fair_odds"),
        F.when(possible, F.coalesce("product", F.lit(1.0))).otherwise(F.lit(0.0)).alias("exact_probability"),
    )


def resolve_picks(picks: DataFrame, teams: DataFrame, games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Game ids of (season, week, winner, opponent) picks, and the picks that name no team or no game."""
    ids = teams.select("team_id", "abbreviation")
    named = (
        picks.join(ids.select(F.col("abbreviation").alias("winner"), F.col("team_id").alias("winner_id")), "winner", "left")
        .join(ids.select(F.col("abbreviation").alias("opponent"), F.col("team_id").alias("opponent_id")), "opponent", "left")
        .withColumn("low_id", F.least("winner_id", "opponent_id"))
        .withColumn("high_id", F.greatest("winner_id", "opponent_id"))
    )
    listed = _with_pair(schedule(games)).groupBy("season_year", "week", "low_id", "high_id").agg(F.min("game_id").alias("game_id"))
    found = named.join(listed, ["season_year", "week", "low_id", "high_id"], "left").drop("low_id", "high_id")
    known = F.col("winner_id").isNotNull() & F.col("opponent_id").isNotNull()
    errors = found.filter(F.col("game_id").isNull()).withColumn(
        "error", F.when(known, "no such game").otherwise("unknown team")
    )
    return found.filter(F.col("game_id").isNotNull()), errors.drop("game_id")
