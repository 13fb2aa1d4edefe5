"""Proper-scoring metrics over forecast samples.

A sample row has ``p`` (home-win probability), ``home_won`` (1/0, null for a tie),
``is_tie`` and ``reason`` (why the model abstained, null when it did not). Ties and
abstentions stay in the table; every metric leaves them out and counts them.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.functions import expr as X
from gridcast.operators import resample
from gridcast.session import stage


def is_scored() -> Column:
    return F.col("reason").isNull() & ~F.col("is_tie")


def exclusion_reason() -> Column:
    """Why a sample does not count; a tie hides an abstention."""
    return F.when(F.col("is_tie"), F.lit("tie")).otherwise(F.col("reason"))


def is_correct() -> Column:
    return (F.col("p") >= 0.5) == (F.col("home_won") == 1)


def with_losses(samples: DataFrame) -> DataFrame:
    """Per-sample squared error, log loss and hit flag; null where the sample does not count."""
    ok = is_scored()
    y = F.col("home_won").cast("double")
    return samples.withColumns(
        {
            "squared_error": F.when(ok, X.squared_error(F.col("p"), y)),
            "log_loss": F.when(ok, X.log_loss(F.col("p"), y)),
            "correct": F.when(ok, is_correct().cast("double")),
            "excluded": F.when(~ok, exclusion_reason()),
        }
    )


def metric_columns() -> list[Column]:
    return [
        F.count("squared_error").alias("sample_count"),
        (F.count(F.lit(1)) - F.count("squared_error")).alias("excluded_count"),
        F.avg("squared_error").alias("brier"),
        F.avg("log_loss").alias("log_loss"),
        F.avg("correct").alias("accuracy"),
    ]


def score(samples: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Brier score, log loss and accuracy per group, in one aggregation."""
    return with_losses(samples).groupBy(*groups).agg(*metric_columns())


def exclusion_counts(samples: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Number of left-out samples per group and reason."""
    return (
        samples.filter(~is_scored())
        .groupBy(*groups, exclusion_reason().alias("excluded"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


BINS = 10
_STATS = ("n", "p", "won", "squared_error", "log_loss", "correct")
_LOSSES = ("squared_error", "log_loss")


def metric_sets(
    samples: DataFrame, sets: Sequence[Sequence[str]], key: str = "game_id",
    resamples: int = K.BOOTSTRAP_RESAMPLES, seed: int = K.SEED, bins: int = BINS,
) -> DataFrame:
    """The whole metric set of every group of several groupings, from one pass over the samples.

    Columns: those of the groupings (null where a grouping does not have them), ``grouping`` (the place of the grouping in
    ``sets``), counts, Brier score, log loss, accuracy, ``brier_low`` to ``log_loss_high`` (bootstrap
    intervals, null under two samples), ``reliability`` (array of bin, n, mean_predicted, actual_rate; empty bins have no entry) and
    ``exclusion_reasons`` (map of reason to count).

    Everything is a sum that can be merged. The narrow samples are stored once; counts and the sums of each reliability bin and
    exclusion reason come from one aggregation over all groupings, the sums of the bootstrap replicates from
    another (``resample.replicate_sums``), both summed on the map side first.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rows = with_losses(samples).withColumns({"won": F.col("home_won").cast("double"), "_h": resample.row_hash(F.col(key), seed), "n": F.lit(1)})
    rows = stage(rows.select(*columns, "excluded", *_STATS, F.when(F.col("excluded").isNull(), X.reliability_bin(F.col("p"), bins)).alias("bin"), "_h"))
    cells = rows.groupingSets([[F.col(c) for c in (*s, "bin", "excluded")] for s in sets], *columns, "bin", "excluded").agg(
        F.grouping_id().alias("_id"), *[F.sum(c).alias(c) for c in _STATS]
    )
    number = {_grouping_id(s, columns): i for i, s in enumerate(sets)}
    placed = cells.withColumn("grouping", F.coalesce(*[F.when(F.col("_id") == k, F.lit(i)) for k, i in number.items()]))
    in_bin = F.col("bin").isNotNull()
    total = lambda c: F.sum(F.when(in_bin, F.col(c)))
    one = F.struct("bin", "n", (F.col("p") / F.col("n")).alias("mean_predicted"), (F.col("won") / F.col("n")).alias("actual_rate"))
    done = placed.groupBy("grouping", *columns).agg(
        F.coalesce(total("n"), F.lit(0)).alias("sample_count"), F.coalesce(F.sum(F.when(~in_bin, F.col("n"))), F.lit(0)).alias("excluded_count"),
        (total("squared_error") / total("n")).alias("brier"), (total("log_loss") / total("n")).alias("log_loss"), (total("correct") / total("n")).alias("accuracy"),
        F.array_sort(F.collect_list(F.when(in_bin, one))).alias("reliability"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~in_bin, F.struct("excluded", "n"))))).alias("exclusion_reasons"),
    )
    sums = resample.replicate_sums(rows.filter("excluded IS NULL"), sets, _LOSSES, resamples, seed)
    means = sums.groupBy("grouping", *columns).agg(*[F.collect_list(F.when(F.col("w") > 0, F.col(v) / F.col("w"))).alias(f"_{v}") for v in _LOSSES])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("grouping", *columns)]
    done = done.alias("a").join(means.alias("b"), functools.reduce(Column.__and__, same), "left").select("a.*", *[f"b._{v}" for v in _LOSSES])
    ends = [
        F.when(F.col("sample_count") >= 2, end).alias(f"{name}_{side}")
        for v, name in zip(_LOSSES, ("brier", "log_loss"), strict=True) for side, end in zip(("low", "high"), resample.percentiles(F.col(f"_{v}")), strict=True)
    ]
    kept = ["sample_count", "excluded_count", "brier", "log_loss", "accuracy"]
    return done.select("grouping", *columns, *kept, *ends, "reliability", "exclusion_reasons")


def _grouping_id(held: Sequence[str], columns: Sequence[str]) -> int:
    """The grouping id of a set over ``columns`` and two more columns that all sets hold: a bit for each column it lacks."""
    return sum(1 << (len(columns) + 1 - i) for i, c in enumerate(columns) if c not in held)


def metric_set(samples: DataFrame, groups: Sequence[str], **given) -> DataFrame:
    """The metric set of each group of one grouping (see ``metric_sets``)."""
    return metric_sets(samples, [groups], **given).drop("grouping")


def reliability(samples: DataFrame, groups: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Mean forecast against actual win rate in equal-width bins; empty bins have no row."""
    return (
        samples.filter(is_scored())
        .withColumn("bin", X.reliability_bin(F.col("p"), bins))
        .groupBy(*groups, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("p").alias("mean_predicted"),
            F.avg(F.col("home_won").cast("double")).alias("actual_rate"),
        )
    )


def margin_score(samples: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Error of ``predicted`` against ``actual`` margins; ties count, abstentions (null) do not."""
    error = F.col("actual") - F.col("predicted")
    return samples.groupBy(*groups).agg(
        F.count("predicted").alias("sample_count"),
        (F.count(F.lit(1)) - F.count("predicted")).alias("excluded_count"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.var_samp(error).alias("residual_variance"),
        F.stddev_samp(error).alias("residual_stdev"),
    )


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Content checksum of a table that does not depend on row order.

    Each row is hashed and the hashes are added up piecewise, so it is a plain
    map-side aggregation: no sort and nothing collected. Every value is written with its length and a null as
    ``-``, so neither nulls nor separators inside values make different rows look alike.
    """
    written = [F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    h = F.sha2(F.concat_ws("|", *written), 256)
    piece = lambda start: F.conv(F.substring(h, start, 13), 16, 10).cast("decimal(20,0)")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(piece(1)).alias("a"), F.sum(piece(14)).alias("b")
    ).select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("checksum"))
