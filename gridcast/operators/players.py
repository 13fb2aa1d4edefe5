"""Player usage as of a cutoff, starters and replacements, and the win-probability impact of a player."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast import constants as K
from gridcast.functions import expr as X
from gridcast.functions.draws import Draws
from gridcast.operators.asof import Measures, asof_aggregate, best_of_intervals, timeline
from gridcast.operators.sides import side_probes
from gridcast.operators.strength import scoring_totals, team_strength
from gridcast.session import spread, stage

CATEGORIES = sorted(K.PRODUCTION_WEIGHTS)
TEAM_SEASON = ["team_id", "season_year"]
PLAYER = [*TEAM_SEASON, "player_id"]


def production(category: Column, labels: Column, values: Column) -> Column:
    """Weighted sum of a stat line; unknown categories and labels and unreadable text count nothing."""
    weights = F.create_map(
        *chain.from_iterable((F.lit(f"{c}|{label}"), F.lit(w)) for c, by_label in K.PRODUCTION_WEIGHTS.items() for label, w in by_label.items())
    )
    parts = F.zip_with(
        labels,
        values,
        lambda label, value: F.coalesce(
            F.try_element_at(weights, F.concat(category, F.lit("|"), label)) * value.try_cast("double"), F.lit(0.0)
        ),
    )
    return F.aggregate(parts, F.lit(0.0), lambda acc, part: acc + part)


def scored_statlines(statlines: DataFrame, games: DataFrame) -> DataFrame:
    """Stat lines of weighted categories with their game's season and kickoff and a production score.

    Neither completion nor season type is looked at.
    """
    when = games.select("game_id", "season_year", "kickoff_at")
    # scored before the join: a number is shuffled instead of the texts of a line
    lines = statlines.filter(F.col("stat_category").isin(*CATEGORIES)).select(
        "game_id", "team_id", "player_id",
        F.col("stat_category").alias("category"),
        production(F.col("stat_category"), F.col("stat_labels"), F.col("stat_values")).alias("score"),
    )
    return lines.join(when, "game_id").select("game_id", "season_year", "kickoff_at", "team_id", "player_id", "category", "score")


def _measures() -> Measures:
    out: Measures = {}
    for c in CATEGORIES:
        mine = F.col("category") == c
        out[f"total_{c}"] = ("sum", F.when(mine, F.col("score")).otherwise(F.lit(0.0)))
        out[f"games_{c}"] = ("sum", mine.cast("bigint"))
    return out


def _primary(prefix: str = "") -> Column:
    """The category with the largest total (by name when equal to six decimals), as a struct; null without games."""
    options = [
        F.when(
            F.col(f"{prefix}games_{c}") > 0,
            F.struct(
                F.round(F.col(f"{prefix}total_{c}"), 6).alias("total"),
                F.lit(-i).alias("order"),
                F.lit(c).alias("category"),
                F.col(f"{prefix}games_{c}").alias("games"),
            ),
        )
        for i, c in enumerate(CATEGORIES)
    ]
    return F.greatest(*options)


#: Lines of players that share a hash, up to which each is put in order whole.
_FEW_LINES = 50_000


def usage_timeline(scored: DataFrame, lead: str | None = None) -> DataFrame:
    """Every player's primary category, games and total production as a step function per team and season."""
    steps = timeline(scored, PLAYER, "kickoff_at", _measures(), lead=lead, sparse=_FEW_LINES)
    steps = steps.withColumn("_now", _primary()).withColumn("_was", _primary("before_"))
    return steps.select(
        *PLAYER,
        F.col("kickoff_at").alias("changed_at"),
        "valid_to",
        *([lead, f"next_{lead}"] if lead else []),
        F.col("_now.category").alias("category"),
        F.col("_now.games").alias("games"),
        F.col("_now.total").alias("total"),
        (F.col("_now.total") / F.col("_now.games")).alias("mean"),
        F.col("_was.category").alias("before_category"),
        (F.col("_was.total") / F.col("_was.games")).alias("before_mean"),
    )


def usages_at(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Usage of every player at one cutoff per season (``cutoffs``: season_year, cutoff)."""
    seen = scored.join(cutoffs, "season_year").filter(F.col("kickoff_at") < F.col("cutoff"))
    totals = seen.groupBy(*PLAYER, "cutoff").agg(
        *[(F.sum(col)).alias(name) for name, (_, col) in _measures().items()]
    )
    return totals.withColumn("_now", _primary()).select(
        *PLAYER, "cutoff",
        F.col("_now.category").alias("category"), F.col("_now.games").alias("games"), F.col("_now.total").alias("total"),
        (F.col("_now.total") / F.col("_now.games")).alias("mean"),
    )


def replacements(usages: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The most productive other player of the same group: the runner-up for the top player, the top player for the rest.

    Only the two best of a group are ranked, so a crowded group costs two rows per task.
    """
    groups = list(groups)
    order = Window.partitionBy(*groups).orderBy(F.col("total").desc(), "player_id")
    top = usages.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= 2)
    best = top.groupBy(*groups).agg(
        F.max(F.when(F.col("_place") == 1, F.col("player_id"))).alias("_first"),
        F.max(F.when(F.col("_place") == 2, F.col("player_id"))).alias("_second"),
    )
    other = F.when(F.col("player_id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    return usages.join(best, groups).withColumn("replacement_id", other).drop("_first", "_second")


def depth_chart(probes: DataFrame, scored: DataFrame) -> DataFrame:
    """First and second player of every category at every (team, season, cutoff).

    A player's usage is a step function; at a cutoff the two best of all active
    steps are wanted. Steps are placed on the axis of a team's own cutoffs and
    looked up through :func:`best_of_intervals`, so neither the players nor the
    cutoffs of a busy team are multiplied with each other.
    """
    axis = stage(probes.select(*TEAM_SEASON, "cutoff").distinct())
    # The place of a moment on the axis is the number of cutoffs up to it, summed in two levels: no task orders a whole axis.
    moments = axis.withColumnRenamed("cutoff", "at").unionByName(scored.select(*TEAM_SEASON, F.col("kickoff_at").alias("at")))
    reached = stage(asof_aggregate(
        moments, axis, TEAM_SEASON, "cutoff", {"lo": ("sum", F.lit(1).cast("bigint"))}, probe_ts="at", inclusive=True,
    ))
    sizes = axis.groupBy(*TEAM_SEASON).agg(F.count(F.lit(1)).alias("axis_size"))
    axis = axis.join(reached.withColumnRenamed("at", "cutoff"), [*TEAM_SEASON, "cutoff"]).withColumn("position", F.col("lo") - 1).drop("lo").join(sizes, TEAM_SEASON)
    placed = scored.join(reached.withColumnRenamed("at", "kickoff_at"), [*TEAM_SEASON, "kickoff_at"])
    steps = (
        usage_timeline(placed, lead="lo")
        .join(sizes, TEAM_SEASON)
        .withColumn("hi", F.coalesce("next_lo", "axis_size"))
        .select(*PLAYER, "category", "games", "total", "mean", "lo", "hi")
    )
    return best_of_intervals(
        axis, steps, TEAM_SEASON, ["category"],
        [F.col("total").desc(), F.col("player_id")], 2, ["player_id", "games", "total", "mean"],
    ).drop("position", "axis_size")


def usual_starters(chart: DataFrame, minimum_games: int = K.MINIMUM_STARTER_GAMES) -> DataFrame:
    """The top player of each category, kept only with enough games; the runner-up never moves up."""
    return chart.filter((F.col("place") == 1) & (F.col("games") >= minimum_games)).drop("place")


def category_prior(probes: DataFrame, scored: DataFrame) -> DataFrame:
    """Mean of the players' mean production per (team, season, category, cutoff).

    Every change of a player takes its old mean out of its old category and puts
    the new one in, so the category mean is a running sum over those changes.
    """
    steps = usage_timeline(scored)
    changes = (
        steps.withColumn(
            "_change",
            F.explode(
                F.array(
                    F.struct(F.col("category").alias("category"), F.col("mean").alias("d_mean"), F.lit(1).alias("d_players")),
                    F.struct(F.col("before_category").alias("category"), (-F.col("before_mean")).alias("d_mean"), F.lit(-1).alias("d_players")),
                )
            ),
        )
        .select(*TEAM_SEASON, "changed_at", "_change.*")
        .filter(F.col("category").isNotNull())
    )
    got = asof_aggregate(
        probes, changes, [*TEAM_SEASON, "category"], "changed_at",
        {"sum_mean": ("sum", F.col("d_mean")), "players": ("sum", F.col("d_players"))}, probe_ts="cutoff",
    )
    return got.withColumn("category_mean", F.when(F.col("players") > 0, F.col("sum_mean") / F.col("players"))).drop("sum_mean")


def points_per_production(statlines: DataFrame, games: DataFrame) -> DataFrame:
    """League points per unit of production over all completed games, as a one-row table.

    There is no cutoff: later games count too. Pass games limited to a date to close that.
    """
    done = games.filter(F.col("completed") & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    points = done.agg(F.sum(F.col("home_score") + F.col("away_score")).alias("points"))
    score = production(F.col("stat_category"), F.col("stat_labels"), F.col("stat_values"))
    made = statlines.join(done.select("game_id"), "game_id", "left_semi").agg(F.sum(score).alias("made"))
    return made.withColumn("points", points.scalar()).select(
        F.when(F.col("made") > 0, F.col("points") / F.col("made")).alias("points_per_production")
    )


def starter_table(games: DataFrame, scored: DataFrame, minimum_games: int = K.MINIMUM_STARTER_GAMES) -> DataFrame:
    """Usual starters of both sides of every game, with replacement and category mean at the game's cutoff."""
    probes = side_probes(games)
    chart = stage(depth_chart(probes, scored))
    starters = usual_starters(chart, minimum_games)
    second = chart.filter("place = 2").select(
        *TEAM_SEASON, "cutoff", "category",
        F.col("player_id").alias("replacement_id"),
        F.col("games").alias("replacement_games"),
        F.col("mean").alias("replacement_mean"),
    )
    keys = [*TEAM_SEASON, "cutoff", "category"]
    known = starters.join(second, keys, "left").join(category_prior(starters, scored), keys, "left")
    sides = games.select(
        "game_id", "season_year", "cutoff", "neutral_site",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("is_home"), F.col("home_team_id").alias("team_id"), F.col("away_team_id").alias("opponent_id")),
                F.struct(F.lit(False).alias("is_home"), F.col("away_team_id").alias("team_id"), F.col("home_team_id").alias("opponent_id")),
            )
        ).alias("_side"),
    ).select("game_id", "season_year", "cutoff", "neutral_site", "_side.*")
    # two rows a game, which a few columns of compressed files do not show
    return sides.hint("merge").join(known, [*TEAM_SEASON, "cutoff"])


def missing_from_box_score(starters: DataFrame, statlines: DataFrame) -> DataFrame:
    """Starters without any stat line in the game they were expected in.

    Two columns of compressed files look small to the optimizer, but are a row for every stat line there is: merged, never broadcast.
    """
    return starters.join(statlines.select("game_id", "player_id").hint("merge"), ["game_id", "player_id"], "left_anti")


def _with_reasons(wanted: DataFrame, games: DataFrame, history: DataFrame, exponent: float) -> DataFrame:
    rated = team_strength(scoring_totals(side_probes(games), history), exponent)
    own = rated.select(*TEAM_SEASON, "cutoff", F.col("ppg_for"), F.col("ppg_against"), F.col("reason").alias("team_reason"))
    other = rated.select(
        F.col("team_id").alias("opponent_id"), "season_year", "cutoff",
        F.col("strength").alias("opponent_strength"), F.col("reason").alias("opponent_reason"),
    )
    return wanted.join(own, [*TEAM_SEASON, "cutoff"]).join(other, ["opponent_id", "season_year", "cutoff"])


def _with_strengths(wanted: DataFrame, games: DataFrame, history: DataFrame, exponent: float) -> DataFrame:
    df = _with_reasons(wanted, games, history, exponent)
    return df.filter(F.col("team_reason").isNull() & F.col("opponent_reason").isNull()).drop("team_reason", "opponent_reason")


def _win_probability(df: DataFrame, name: str, ppg_for: Column, ppg_against: Column, exponent: float) -> DataFrame:
    floor = F.lit(K.RATE_FLOOR)
    df = df.withColumn("_s", X.pythagorean(F.greatest(ppg_for, floor), F.greatest(ppg_against, floor), exponent))
    df = df.withColumn("_raw", X.log5(F.col("_s"), F.col("opponent_strength")))
    return df.withColumn(name, X.with_home_field(F.col("_raw"), F.col("neutral_site"))).drop("_s", "_raw")


def with_and_without(df: DataFrame, player_mean: Column, conversion: Column, exponent: float = K.PYTHAGOREAN_EXPONENT) -> DataFrame:
    """Win probability with the player and with the replacement in his place.

    Offence moves points scored, defence points conceded; the home bump follows the
    site and is given to the player's own side.
    """
    k = K.PLAYER_PSEUDOGAMES
    kept = X.shrink(player_mean, F.col("games"), F.col("category_mean"), k)
    filled = X.shrink(F.col("replacement_mean"), F.col("replacement_games"), F.col("category_mean"), k)
    df = df.withColumn("points_gap", (kept - F.coalesce(filled, F.lit(0.0))) * conversion)
    offence = F.col("category").isin(*K.OFFENSIVE_CATEGORIES)
    gap, zero = F.col("points_gap"), F.lit(0.0)
    df = _win_probability(df, "p_with", F.col("ppg_for"), F.col("ppg_against"), exponent)
    return _win_probability(
        df, "p_without",
        F.col("ppg_for") - F.when(offence, gap).otherwise(zero),
        F.col("ppg_against") + F.when(offence, zero).otherwise(gap),
        exponent,
    )


#: Places drawn from, times replicates, that a task holds at a time.
_WEIGHTS = 4_000_000


@lru_cache(maxsize=32)
def _drawn_places(n: int, resamples: int, seed: int) -> np.ndarray:
    """[place, replicate]: how often each of n places is drawn in n slots of a replicate."""
    return _drawn_weights(n, range(resamples), seed)


def _drawn_weights(n: int, replicates: range, seed: int) -> np.ndarray:
    weights, draws = np.zeros(n * len(replicates)), Draws(seed, replicates)
    for start in range(0, n, _WEIGHTS // 100):
        for _, drawn in draws.of([b"%d" % slot for slot in range(start, min(n, start + _WEIGHTS // 100))]):
            place = np.floor(drawn * (1.0 / (1 << 52)) * n).astype(np.int64)
            np.add.at(weights, (place * len(replicates) + np.arange(len(replicates))).ravel(), 1.0)
    return weights.reshape(n, len(replicates))


def _means(keys: Sequence[str], resamples: int, seed: int):
    """mapInArrow: the replicate means of each state, from the scores of its games in order. States with the same number of games share their draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_scores")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            scores = lists.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
            for first in range(0, batch.num_rows, _STATES):
                some = batch.slice(first, _STATES)
                means = np.zeros((some.num_rows, resamples))
                size = sizes[first : first + some.num_rows]
                for n in np.unique(size):
                    at = np.flatnonzero(size == n)
                    wide = max(1, _WEIGHTS // max(1, int(n)))
                    for low in range(0, resamples, wide):
                        high = min(resamples, low + wide)
                        whole = low == 0 and high == resamples and n <= 1000
                        weights = _drawn_places(int(n), resamples, seed) if whole else _drawn_weights(int(n), range(low, high), seed)
                        step = max(1, _WEIGHTS // max(1, int(n)))
                        for start in range(0, len(at), step):
                            part = at[start : start + step]
                            held = np.stack([scores[ends[first + i] : ends[first + i + 1]] for i in part])
                            means[part, low:high] = held @ weights / n
                spots = pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * resamples)
                columns = [some.column(k) for k in (*keys, "games")]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(spots, means.ravel())], [*keys, "games", "resampled_means"])

    return run


#: States whose means are held at a time.
_STATES = 1000


def resampled_means(states: DataFrame, scored: DataFrame, resamples: int, seed: int) -> DataFrame:
    """Bootstrap means of each player's per-game production, for each number of games so far, as an array over replicates.

    A draw is a hash of the replicate and the slot, scaled to the number of games. So states with the same count share their draws, and a mean is
    a product of the scores so far and how often each place is drawn; no record is made for a draw.
    """
    keys = [*PLAYER, "category"]
    wanted = stage(states.select(*keys, "games").distinct())
    # a player's lines by kickoff, then game, then score
    ordered = F.array_sort(F.collect_list(F.struct("kickoff_at", "game_id", "score")))
    lines = scored.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.transform(ordered, lambda line: line["score"]).alias("_all"))
    held = wanted.join(lines, keys).select(*keys, "games", F.slice("_all", F.lit(1), F.col("games").cast("int")).alias("_scores"))
    # dealt by states: one costs its games times the replicates, however few bytes it has
    kinds = {f.name: f for f in held.schema.fields}
    schema = T.StructType([*[kinds[k] for k in (*keys, "games")], T.StructField("resampled_means", T.ArrayType(T.DoubleType()))])
    return spread(held, *keys, "games").mapInArrow(_means(keys, resamples, seed), schema)


def impact_reasons(wanted: DataFrame, games: DataFrame, history: DataFrame, exponent: float = K.PYTHAGOREAN_EXPONENT) -> DataFrame:
    """``wanted`` with both sides' strength and, where :func:`player_impact` has no estimate, its ``abstain_reason``; nothing is drawn."""
    reason = F.coalesce(F.when(F.col("replacement_id").isNull(), F.lit(K.NO_REPLACEMENT)), F.col("team_reason"), F.col("opponent_reason"))
    return _with_reasons(wanted, games, history, exponent).withColumn("abstain_reason", reason).drop("team_reason", "opponent_reason")


def player_impact(
    wanted: DataFrame,
    games: DataFrame,
    history: DataFrame,
    statlines: DataFrame,
    scored: DataFrame,
    resamples: int = K.IMPACT_RESAMPLES,
    seed: int = K.SEED,
    exponent: float = K.PYTHAGOREAN_EXPONENT,
) -> DataFrame:
    """Mean and spread of a starter's win-probability impact over bootstrap draws of his production.

    ``wanted`` is a part of :func:`starter_table`. Every row is returned: those without a replacement or
    without a usable strength of either side have no estimate but an ``abstain_reason``.
    """
    known = stage(impact_reasons(wanted, games, history, exponent))
    rows = known.filter(F.col("abstain_reason").isNull())
    means = resampled_means(rows, scored, resamples, seed)
    conversion = points_per_production(statlines, history).scalar()
    # A row meets as many means as there are replicates, so the join is spread by rows made and not by bytes read, and they are written out after it.
    keys = [*PLAYER, "category", "games"]
    met = spread(rows, *keys).join(spread(means, *keys), keys)
    drawn = met.select(*rows.columns, F.explode("resampled_means").alias("resampled_mean"))
    shifted = with_and_without(drawn, F.col("resampled_mean"), conversion, exponent)
    impact = F.col("p_with") - F.col("p_without")
    columns = ["game_id", "team_id", "player_id", "category", "is_home", "replacement_id", "games"]
    estimated = shifted.groupBy(*columns).agg(F.avg(impact).alias("mean_impact"), F.stddev_pop(impact).alias("impact_stdev"))
    abstained = known.filter(F.col("abstain_reason").isNotNull()).select(*columns, "abstain_reason")
    return estimated.unionByName(abstained, allowMissingColumns=True)


def game_delta(impacts: DataFrame) -> DataFrame:
    """Net change of the home win probability per game when the listed players are missing.

    A game whose every missing starter is abstained on has a row too: without a change, with ``players_abstained``.
    ``adjusted_players`` lists the players behind the change by id; a team has one starter per category, so the list is short.
    """
    signed = F.when(F.col("is_home"), -F.col("mean_impact")).otherwise(F.col("mean_impact"))
    return impacts.groupBy("game_id").agg(
        F.sum(signed).alias("injury_delta"),
        F.nullif(F.count("mean_impact"), F.lit(0)).alias("players_out"),
        F.count("abstain_reason").alias("players_abstained"),
        F.array_sort(F.collect_list(F.when(F.col("mean_impact").isNotNull(), F.col("player_id")))).alias("adjusted_players"),
    )


def shift_probability(p: Column, delta: Column) -> Column:
    return X.clamp(p + F.coalesce(delta, F.lit(0.0)))


def blend(baseline: Column, turnover: Column, schedule: Column) -> Column:
    """Add the turnover and schedule shifts in log-odds space; a missing part shifts nothing."""
    base = X.logit(baseline)
    moved = X.logit(F.coalesce(turnover, baseline)) + X.logit(F.coalesce(schedule, baseline)) - base
    return X.sigmoid(moved)
