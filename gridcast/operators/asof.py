"""As-of aggregates: what was known strictly before each probe.

Written as ``facts JOIN probes ON key AND fact.ts < probe.ts`` the work is
quadratic per key. Here it is linear. Facts are first aggregated to one row per
(key, ts), which also collapses a key holding a large share of the data. Time is
then cut into buckets and the running total is taken in two levels:

* inside each (key, bucket), a window running over at most one bucket of rows;
* over the per-bucket totals of each key, a window over one row per bucket.

So no task ever sorts all rows of a hot key, and every shuffle after the first
moves pre-aggregated rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridcast.functions.expr import days_since_epoch
from gridcast.session import stage

Measures = dict[str, tuple[str, Column]]

DEFAULT_BUCKET_DAYS = 7

_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max, "or": F.bit_or}


def _bucket(ts: str, days: int) -> Column:
    return F.floor(days_since_epoch(F.col(ts)) / F.lit(days)).cast("bigint")


def _per_instant(facts: DataFrame, keys: Sequence[str], ts: str, measures: Measures) -> DataFrame:
    aggs = [_AGGREGATE[kind](col).alias(name) for name, (kind, col) in measures.items()]
    return facts.groupBy(*keys, ts).agg(*aggs)


def asof_aggregate(
    probes: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    ts: str,
    measures: Measures,
    *,
    probe_ts: str | None = None,
    inclusive: bool = False,
    bucket_days: int = DEFAULT_BUCKET_DAYS,
) -> DataFrame:
    """One row per distinct (keys, probe_ts) of ``probes`` with the facts before it aggregated.

    ``measures`` maps an output name to ``(kind, column of facts)`` with kind one
    of sum, min, max, or. A fact at exactly the probe time is left out unless
    ``inclusive``. Sums without any fact are 0; min and max are null.
    """
    keys = list(keys)
    instants = _per_instant(facts, keys, ts, measures).withColumn("_kind", F.lit(1))
    order_of_probe = 2 if inclusive else 0
    probe_ts = probe_ts or ts
    asked = probes.select(*keys, F.col(probe_ts).alias(ts)).distinct().withColumn("_kind", F.lit(order_of_probe))
    rows = instants.unionByName(asked, allowMissingColumns=True).withColumn("_bucket", _bucket(ts, bucket_days))
    carried = _carried(rows, keys, measures)
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(F.col(ts).asc_nulls_first(), "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = rows.unionByName(carried, allowMissingColumns=True).select(
        *keys,
        F.col(ts).alias(probe_ts),
        "_kind",
        *[_over(kind, name, inside).alias(name) for name, (kind, _) in measures.items()],
    )
    return running.filter(F.col("_kind") == order_of_probe).drop("_kind")


def _over(kind: str, name: str, window: WindowSpec) -> Column:
    total = _AGGREGATE[kind](F.col(name)).over(window)
    return F.coalesce(total, F.lit(0)) if kind in ("sum", "or") else total


def _carried(rows: DataFrame, keys: list[str], measures: Measures) -> DataFrame:
    """One row per (key, bucket) with everything before the bucket.

    The row has no time and so sorts first: the running window inside the bucket
    starts from it, and no join is needed to add the two levels up.
    """
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.groupBy(*keys, "_bucket")
        .agg(*[_AGGREGATE[kind](F.col(name)).alias(name) for name, (kind, _) in measures.items()])
        .select(
            *keys,
            "_bucket",
            F.lit(-1).alias("_kind"),
            *[_AGGREGATE[kind](F.col(name)).over(earlier).alias(name) for name, (kind, _) in measures.items()],
        )
    )


def timeline(
    facts: DataFrame,
    keys: Sequence[str],
    ts: str,
    measures: Measures,
    *,
    lead: str | None = None,
    bucket_days: int = DEFAULT_BUCKET_DAYS,
    sparse: int | None = None,
) -> DataFrame:
    """Running totals as a step function: one row per (keys, ts) at which something changes.

    Each row has, per measure, ``name`` (including this instant) and
    ``before_name`` (excluding it), plus ``valid_to``: the next change of the key,
    null for the last. The totals hold for every cutoff in ``(ts, valid_to]``.
    With ``lead`` naming a column that is constant per (key, ts) and grows with
    ``ts``, ``next_<lead>`` holds its value at the next change.

    With ``sparse``, for keys of mostly few facts each: keys that share a hash with at most ``sparse``
    facts are put in order whole, after a single shuffle of their facts. The others, all keys with more
    facts among them, go through buckets as ever. ``facts`` should be staged, as they are counted first.
    """
    keys = list(keys)
    if sparse is not None:
        place = F.pmod(F.xxhash64(*keys), F.lit(_PLACES)).alias("_place")
        crowded = stage(facts.groupBy(place).agg(F.count(F.lit(1)).alias("_facts")).filter(F.col("_facts") > sparse).select("_place"))
        if crowded.isEmpty():
            return _whole_timeline(facts, keys, ts, measures, lead)
        placed = facts.withColumn("_place", place)
        few, many = (placed.join(crowded, "_place", how).drop("_place") for how in ("left_anti", "left_semi"))
        buckets = timeline(many, keys, ts, measures, lead=lead, bucket_days=bucket_days)
        return _whole_timeline(few, keys, ts, measures, lead).unionByName(buckets)
    extra: Measures = {lead: ("max", F.col(lead))} if lead else {}
    rows = (
        _per_instant(facts, keys, ts, {**measures, **extra})
        .withColumn("_bucket", _bucket(ts, bucket_days))
        .withColumn("_kind", F.lit(1))
    )
    # Each bucket gets a first row holding the totals before it and a last row holding
    # the time of the key's next change, so the window inside the bucket needs no join.
    across = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        rows.groupBy(*keys, "_bucket")
        .agg(
            *[_AGGREGATE[kind](F.col(name)).alias(name) for name, (kind, _) in measures.items()],
            F.min(ts).alias("_first"),
            *([F.min(lead).alias("_first_lead")] if lead else []),
        )
        .select(
            *keys,
            "_bucket",
            *[_AGGREGATE[kind](F.col(name)).over(earlier).alias(name) for name, (kind, _) in measures.items()],
            F.lead("_first").over(across).alias("_next"),
            *([F.lead("_first_lead").over(across).alias("_next_lead")] if lead else []),
        )
        # after the windows: exploded in the same select, they would run over doubled rows
        .withColumn("_kind", F.explode(F.array(F.lit(-1), F.lit(2))))
    )
    opens = F.col("_kind") == -1
    frame = buckets.select(
        *keys,
        "_bucket",
        "_kind",
        *[F.when(opens, F.col(name)).alias(name) for name in measures],
        F.when(~opens, F.col("_next")).alias(ts),
        *([F.when(~opens, F.col("_next_lead")).alias(lead)] if lead else []),
    )
    everything = rows.unionByName(frame)
    order = Window.partitionBy(*keys, "_bucket").orderBy("_kind", ts)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    steps = everything.select(
        *keys,
        ts,
        F.lead(ts).over(order).alias("valid_to"),
        "_kind",
        *([lead, F.lead(lead).over(order).alias(f"next_{lead}")] if lead else []),
        *[_over(kind, name, upto).alias(name) for name, (kind, _) in measures.items()],
        *[_over(kind, name, prior).alias(f"before_{name}") for name, (kind, _) in measures.items()],
    )
    return steps.filter(F.col("_kind") == 1).drop("_kind")


#: Hashes whose facts are counted to tell crowded keys.
_PLACES = 1 << 16


def _whole_timeline(facts: DataFrame, keys: list[str], ts: str, measures: Measures, lead: str | None) -> DataFrame:
    """:func:`timeline` with all instants of a key in one window. Facts are dealt by key once; instants and windows are then already in place."""
    extra: Measures = {lead: ("max", F.col(lead))} if lead else {}
    rows = _per_instant(facts.repartition(*keys), keys, ts, {**measures, **extra})
    order = Window.partitionBy(*keys).orderBy(ts)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        *keys,
        ts,
        F.lead(ts).over(order).alias("valid_to"),
        *([lead, F.lead(lead).over(order).alias(f"next_{lead}")] if lead else []),
        *[_over(kind, name, upto).alias(name) for name, (kind, _) in measures.items()],
        *[_over(kind, name, prior).alias(f"before_{name}") for name, (kind, _) in measures.items()],
    )


# --- best-of-interval lookups -------------------------------------------------


def cover_blocks(lo: Column, hi: Column) -> Column:
    """Array of (level, block) structs: the fewest aligned power-of-two blocks covering [lo, hi).

    At level k the aligned blocks inside the interval are ``ceil(lo/2^k)`` up to
    ``floor(hi/2^k)``; only an odd left end and an odd right end are not already
    part of a larger block, so an interval needs at most two blocks per level.
    """
    def ends(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        left = F.ceil(lo / size).cast("bigint")
        right = F.floor(hi / size).cast("bigint")
        ok = left < right
        return F.array(
            F.when(ok & (left % 2 == 1), F.struct(level.cast("int").alias("level"), left.alias("block"))),
            F.when(ok & (right % 2 == 1), F.struct(level.cast("int").alias("level"), (right - 1).alias("block"))),
        )

    top = F.floor(F.log2(F.greatest(hi, F.lit(1)).cast("double"))).cast("int") + 1
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top), ends)))


def holding_blocks(position: Column, size: Column) -> Column:
    """Array of (level, block) structs: every aligned block of a ``size``-long axis that holds ``position``."""
    top = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int") + 1
    return F.transform(
        F.sequence(F.lit(0), top),
        lambda level: F.struct(
            level.cast("int").alias("level"),
            F.floor(position / F.pow(F.lit(2.0), level)).cast("bigint").alias("block"),
        ),
    )


def best_of_intervals(
    probes: DataFrame,
    intervals: DataFrame,
    axis_keys: Sequence[str],
    group_keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    payload: Sequence[str],
) -> DataFrame:
    """The ``k`` best intervals active at each probe position, per group.

    ``probes`` has ``axis_keys``, ``position`` and ``axis_size``; ``intervals`` has
    ``axis_keys``, ``group_keys``, ``lo``, ``hi`` (positions, half-open) and the
    payload. Joining probes to active intervals would emit every (probe, interval)
    pair of an axis. Instead each interval goes to its O(log n) covering blocks,
    each block keeps its ``k`` best, and a probe looks at the O(log n) blocks that
    hold it. The rank filter is pushed below the shuffle by Spark's window group
    limit, so a crowded block sends at most ``k`` rows per task.
    """
    axis_keys, group_keys = list(axis_keys), list(group_keys)
    spread = (
        intervals.filter(F.col("lo") < F.col("hi"))
        .withColumn("_node", F.explode(cover_blocks(F.col("lo"), F.col("hi"))))
        .select(*axis_keys, *group_keys, *payload, F.col("_node.level").alias("_level"), F.col("_node.block").alias("_block"))
    )
    in_block = Window.partitionBy(*axis_keys, "_level", "_block", *group_keys).orderBy(*order)
    kept = spread.withColumn("_rank", F.row_number().over(in_block)).filter(F.col("_rank") <= k).drop("_rank")
    looks = probes.withColumn(
        "_node", F.explode(holding_blocks(F.col("position"), F.col("axis_size")))
    ).select(*probes.columns, F.col("_node.level").alias("_level"), F.col("_node.block").alias("_block"))
    found = looks.join(kept, [*axis_keys, "_level", "_block"])
    at_probe = Window.partitionBy(*axis_keys, "position", *group_keys).orderBy(*order)
    return (
        found.withColumn("place", F.row_number().over(at_probe))
        .filter(F.col("place") <= k)
        .drop("_level", "_block")
    )
