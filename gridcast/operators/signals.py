"""Market signals, a compounding backtest and stake sizing over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions import expr as X


def _signal(df: DataFrame, strategy: str, market: str, side: Column, edge: Column, floor: float, reason: Column | str, keep: list[str]) -> DataFrame:
    text = reason if isinstance(reason, Column) else F.lit(reason)
    return df.select(
        *keep,
        F.lit(strategy).alias("strategy"),
        F.col(market).cast("string").alias("market_id"),
        side.alias("side"),
        edge.alias("edge"),
        F.least(F.lit(1.0), F.lit(floor) + edge).alias("confidence"),
        text.alias("reason"),
    )


def value_signals(quotes: DataFrame, probabilities: DataFrame, min_edge: float = 0.03, keep: tuple[str, ...] = ()) -> DataFrame:
    """Buy YES where the model beats the yes price by ``min_edge``, else NO where its complement beats the no price."""
    df = quotes.join(probabilities, "market_id")
    yes = F.col("model_probability") - F.col("yes_price")
    no = (1 - F.col("model_probability")) - F.col("no_price")
    df = df.withColumn("_yes", yes).withColumn("_no", no).filter((F.col("_yes") >= min_edge) | (F.col("_no") >= min_edge))
    take_yes = F.col("_yes") >= min_edge
    return _signal(
        df, "value", "market_id", F.when(take_yes, "YES").otherwise("NO"),
        F.when(take_yes, F.col("_yes")).otherwise(F.col("_no")), 0.5,
        F.when(take_yes, "model above yes price").otherwise("model complement above no price"), list(keep),
    )


def arbitrage_signals(odds: DataFrame, max_total: float = 0.99) -> DataFrame:
    """Events whose best home and best away odds imply less than ``max_total`` together."""
    best = odds.groupBy("event_id").agg(F.max("home_decimal_odds").alias("h"), F.max("away_decimal_odds").alias("a"))
    total = 1 / F.col("h") + 1 / F.col("a")
    df = best.withColumn("_total", total).filter(F.col("_total") < max_total)
    return _signal(df, "arbitrage", "event_id", F.lit("BOTH"), 1 - F.col("_total"), 0.6, "implied total below one", [])


def consensus_signals(quotes: DataFrame, odds: DataFrame, min_gap: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """Quotes away from the books' mean implied home probability by ``min_gap``."""
    mean = odds.groupBy(F.col("event_id").alias("market_id")).agg(F.avg(1 / F.col("home_decimal_odds")).alias("_mean"))
    df = quotes.join(mean, "market_id").withColumn("_gap", F.col("_mean") - F.col("yes_price"))
    df = df.filter(F.abs("_gap") >= min_gap)
    return _signal(
        df, "consensus", "market_id", F.when(F.col("_gap") > 0, "YES").otherwise("NO"), F.abs("_gap"), 0.55, "books against price", list(keep)
    )


def momentum_signals(prices: DataFrame, window: int = 5, threshold: float = 0.03, tie: str = "quote_id") -> DataFrame:
    """Markets whose latest price moved by ``threshold`` against ``window`` rows earlier.

    Only the last ``window + 1`` rows of a market are ranked. The rank filter runs
    before the shuffle too, so a market with a large share of all prices sends a
    handful of rows per task.
    """
    latest = Window.partitionBy("market_id").orderBy(F.col("ts").desc(), F.col(tie).desc())
    tail = prices.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= window + 1)
    ends = tail.groupBy("market_id").agg(
        F.max(F.when(F.col("_back") == 1, F.col("yes_price"))).alias("_now"),
        F.max(F.when(F.col("_back") == window + 1, F.col("yes_price"))).alias("_then"),
    )
    move = F.try_divide(F.col("_now"), F.col("_then")) - 1
    df = ends.withColumn("_move", move).filter(F.abs("_move") >= threshold)
    return _signal(
        df, "momentum", "market_id", F.when(F.col("_move") > 0, "YES").otherwise("NO"), F.abs("_move"), 0.5, f"{window}-step price move", []
    )


def binary_backtest(bets: DataFrame, groups: list[str], stake: float = 0.01, bankroll: float = 10000.0) -> DataFrame:
    """Result of staking a fixed share of the bankroll on every bet with an edge, per group.

    Each bet multiplies the bankroll by a factor that does not depend on the others,
    so the end is a product and needs no ordering: a sum of logarithms, combined on
    the map side.
    """
    if not 0 < stake < 1:
        raise ValueError("the stake share must lie between 0 and 1")
    taken = bets.filter(F.col("win_probability") > 1 / F.col("decimal_odds"))
    won = F.col("outcome") == 1
    factor = F.when(won, 1 + F.lit(stake) * (F.col("decimal_odds") - 1)).otherwise(F.lit(1 - stake))
    result = taken.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum(won.cast("bigint")).alias("wins"),
        F.sum((~won).cast("bigint")).alias("losses"),
        F.sum(F.log(factor)).alias("_growth"),
    )
    everyone = bets.select(*groups).distinct() if groups else bets.sparkSession.range(1).drop("id")
    df = everyone.join(result, groups, "left") if groups else result
    end = F.lit(bankroll) * F.exp(F.coalesce("_growth", F.lit(0.0)))
    return df.fillna(0, ["trades", "wins", "losses"]).select(
        *groups, "trades", "wins", "losses", F.round(end - bankroll, 2).alias("pnl"), F.round(end, 2).alias("ending_bankroll")
    )


def kelly_stakes(signals: DataFrame, probability: str, odds: str, bankroll: float, cap: float = 0.05) -> DataFrame:
    """Capped Kelly share and stake for every row."""
    df = signals.withColumn("fraction", X.kelly_fraction(F.col(probability), F.col(odds), cap))
    return df.withColumn("stake", X.position_size(F.lit(bankroll), F.col("fraction")))
