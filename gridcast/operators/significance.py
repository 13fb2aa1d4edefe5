"""Paired tests per group: normal z on differences, exact Fisher and exact McNemar."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.special import log_gamma_step, normal_two_sided_p
from gridcast.session import stage

_CHUNK = 1 << 12


def _shares(
    tables: DataFrame, keys: Sequence[str], lo: str, hi: str, log_ratio: Callable[[Column], Column], step: Callable[[Column], Column],
    most: str, within: Callable[[Column, Column], Column],
) -> DataFrame:
    """Per table the sums ``_part`` (of the terms ``within``) and ``_whole`` over x in [lo, hi] of exp(log_ratio(x) - most).

    A row is a chunk of x, spread over the cluster, so a wide table is not one task. The closed form gives the first logarithm of a chunk;
    from one x to the next ``step``, the logarithm of the ratio of two neighbours, is added.
    """
    chunks = tables.withColumn("_from", F.explode(F.sequence(F.col(lo), F.col(hi), F.lit(_CHUNK).cast("bigint"))))
    chunks = chunks.repartition(*keys, "_from").withColumn("_log", log_ratio(F.col("_from")))

    def add(sums: Column, x: Column) -> Column:
        share = F.exp(sums["log"] - F.col(most))
        part = F.when(within(x, sums["log"]), share).otherwise(0.0)
        return F.struct((sums["part"] + part).alias("part"), (sums["whole"] + share).alias("whole"), F.coalesce(sums["log"] + step(x), F.lit(0.0)).alias("log"))

    start = F.struct(F.lit(0.0).alias("part"), F.lit(0.0).alias("whole"), F.coalesce("_log", F.lit(0.0)).alias("log"))
    each = F.aggregate(F.sequence(F.col("_from"), F.least(F.col("_from") + (_CHUNK - 1), F.col(hi))), start, add)
    return chunks.select(*keys, each.alias("_s")).groupBy(*keys).agg(F.sum("_s.part").alias("_part"), F.sum("_s.whole").alias("_whole"))


def fisher_exact(tables: DataFrame, keys: Sequence[str], cells: Sequence[str] = ("a", "b", "c", "d"), name: str = "fisher_p") -> DataFrame:
    """Two-sided exact p of each 2x2 table: the summed chance of all tables no likelier than the seen one.

    Chances are ratios: to the seen table where they are compared with it, to the likeliest one where they are added up, and the sum over
    all tables stands for one. No absolute chance is formed, so counts of any size keep their digits and
    tables exactly as likely as the seen one are found as such.
    """
    keys = list(keys)
    a, b, c, d = (F.col(x).cast("bigint") for x in cells)
    shaped = tables.select(
        *keys,
        a.alias("_a"),
        (a + b).alias("_row1"),
        (c + d).alias("_row2"),
        (a + c).alias("_col1"),
        (a + b + c + d).alias("_n"),
    ).select(
        "*",
        F.greatest(F.lit(0).cast("bigint"), F.col("_col1") - F.col("_row2")).alias("_lo"),
        F.least("_row1", "_col1").alias("_hi"),
    )

    def log_ratio(x: Column) -> Column:
        """ln of the chance of a table with ``x`` in its first cell over that of the seen one."""
        seen, k = F.col("_a"), x - F.col("_a")
        grows = log_gamma_step(seen + 1, k) + log_gamma_step(F.col("_row2") - F.col("_col1") + seen + 1, k)
        return -(grows + log_gamma_step(F.col("_row1") - seen + 1, -k) + log_gamma_step(F.col("_col1") - seen + 1, -k))

    mode = F.floor((F.col("_row1") + 1) * ((F.col("_col1") + 1) / (F.col("_n") + 2))).cast("bigint")
    placed = shaped.withColumn("_mode", F.least(F.greatest(mode, "_lo"), "_hi"))
    known = placed.withColumn("_most", log_ratio(F.col("_mode")))
    to_next = lambda x: F.log(
        ((F.col("_row1") - x) / (x + 1)) * ((F.col("_col1") - x) / (F.col("_row2") - F.col("_col1") + x + 1))
    )
    sums = _shares(known, keys, "_lo", "_hi", log_ratio, to_next, "_most", lambda x, log: log <= 1e-7)
    return sums.select(*keys, (F.col("_part") / F.col("_whole")).alias(name))


def mcnemar_exact(tables: DataFrame, keys: Sequence[str], only_a: str, only_b: str, name: str = "mcnemar_p") -> DataFrame:
    """Two-sided exact binomial p on the discordant pairs; 1 when there are none. Chances are ratios to the middle one (see ``fisher_exact``)."""
    keys = list(keys)
    a, b = F.col(only_a).cast("bigint"), F.col(only_b).cast("bigint")
    shaped = tables.select(*keys, (a + b).alias("_n"), F.least(a, b).alias("_k"), F.lit(0).cast("bigint").alias("_zero"))
    shaped = shaped.withColumn("_mid", F.floor(F.col("_n") / 2).cast("bigint")).withColumn("_most", F.lit(0.0))

    def log_ratio(x: Column) -> Column:
        k = x - F.col("_mid")
        return -(log_gamma_step(F.col("_mid") + 1, k) + log_gamma_step(F.col("_n") - F.col("_mid") + 1, -k))

    sums = _shares(shaped, keys, "_zero", "_n", log_ratio, lambda x: F.log((F.col("_n") - x) / (x + 1)), "_most", lambda x, log: x <= F.col("_k"))
    return sums.select(*keys, F.least(F.lit(1.0), F.lit(2.0) * F.col("_part") / F.col("_whole")).alias(name))


def paired_z(differences: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """z statistic and two-sided normal p of the mean difference; null under two rows or without spread."""
    stats = differences.groupBy(*groups).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean_difference"), F.stddev_samp(value).alias("_sd")
    )
    z = F.when((F.col("n") >= 2) & (F.col("_sd") > 0), F.col("mean_difference") / (F.col("_sd") / F.sqrt(F.col("n"))))
    return stats.withColumn("z", z).withColumn("p_value", normal_two_sided_p(F.col("z"))).drop("_sd")


def paired_counts(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Hit counts of two predictors on the same games (columns ``baseline_hit``, ``candidate_hit``)."""
    b, c = F.col("baseline_hit"), F.col("candidate_hit")
    count = lambda cond: F.sum(cond.cast("bigint"))
    return pairs.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("sample_count"),
        count(b).alias("baseline_correct"),
        count(c).alias("candidate_correct"),
        count(b & ~c).alias("only_baseline"),
        count(c & ~b).alias("only_candidate"),
    )


def paired_significance(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counts with both exact p-values per group."""
    groups = list(groups)
    counts = stage(paired_counts(pairs, groups))  # one row per group, read three times
    cells = counts.select(
        *groups,
        F.col("baseline_correct").alias("a"),
        (F.col("sample_count") - F.col("baseline_correct")).alias("b"),
        F.col("candidate_correct").alias("c"),
        (F.col("sample_count") - F.col("candidate_correct")).alias("d"),
    )
    return counts.join(fisher_exact(cells, groups), groups).join(
        mcnemar_exact(counts, groups, "only_baseline", "only_candidate"), groups
    )
