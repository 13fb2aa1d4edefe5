"""Seeded samples and bootstrap intervals that do not depend on partitioning.

Bootstraps and season trials are the places of the library, the corpus operators aside, that leave column expressions: adding up arrays of a thousand
weights is not among them, and as one record for each row and replicate it took a hundred times as long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridcast import constants as K
from gridcast.functions.draws import Draws
from gridcast.session import spread, stage

_PREFIX = 3  # hex digits: 4096 evenly filled ranges of the hash, whatever the ids look like


def _hashed(df: DataFrame, key: str, salt: Column) -> DataFrame:
    digest = F.md5(F.concat_ws("|", salt, F.col(key).cast("string")))
    return df.withColumn("_hash", digest).withColumn("_range", F.substring(digest, 1, _PREFIX))


def _range_offsets(hashed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows per hash range and rows in all earlier ranges: at most 4096 rows per group."""
    upto = Window.partitionBy(*groups).orderBy("_range")
    return (
        hashed.groupBy(*groups, "_range")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_total", F.sum("_size").over(Window.partitionBy(*groups)))
    )


def shuffled_position(df: DataFrame, key: str, seed: int, groups: Sequence[str]) -> DataFrame:
    """Attach ``position`` 0..n-1 in hash order and the group size ``n``.

    A row's place is its rank inside its hash range plus the sizes of the earlier
    ranges, so the sort is spread over 4096 ranges instead of one global order.
    """
    groups = list(groups)
    hashed = _hashed(df, key, F.lit(str(seed)))
    inside = Window.partitionBy(*groups, "_range").orderBy("_hash", key)
    return (
        hashed.withColumn("_rank", F.row_number().over(inside))
        .join(_range_offsets(hashed, groups), [*groups, "_range"])
        .withColumn("position", F.col("_before") + F.col("_rank") - 1)
        .withColumn("n", F.col("_total"))
        .drop("_hash", "_range", "_rank", "_size", "_before", "_total")
    )


def holdout(df: DataFrame, key: str, groups: Sequence[str], fraction: float = K.HOLDOUT_FRACTION, seed: int = K.SEED) -> DataFrame:
    """A reproducible random subset of ``round(n * fraction)`` rows per group (half to even)."""
    if not 0 < fraction <= 1:
        raise ValueError("the holdout fraction must lie in (0, 1]")
    return (
        shuffled_position(df, key, seed, groups)
        .filter(F.col("position") < F.bround(F.col("n") * F.lit(fraction)))
        .drop("position", "n")
    )


#: Draws are uniform in [0, PRIME).
PRIME = (1 << 31) - 1


def poisson_steps() -> list[int]:
    """The weight of a draw u is the number of these steps with u >= step: the distribution function of Poisson(1) in ``PRIME`` parts."""
    steps, term, total = [], math.exp(-1), 0.0
    while len(steps) < 11:
        total += term
        term /= len(steps) + 1
        steps.append(math.floor(PRIME * total))
    return steps


def replicate_constants(resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, c) of each replicate, from the md5 of seed and replicate: a row with hash h draws (a h + c) mod PRIME. Products stay below 2^62."""
    digests = [hashlib.md5(f"{seed}|{replicate}".encode()).hexdigest() for replicate in range(resamples)]
    return np.array([int(d[:8], 16) % (PRIME - 1) + 1 for d in digests]), np.array([int(d[8:16], 16) % PRIME for d in digests])


def row_hash(key: Column, seed: int) -> Column:
    """A row's place in [0, PRIME), from the md5 of seed and key: the only text that is hashed, once a row."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(PRIME))


def poisson_weights(h: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """[row, replicate]: Poisson(1) weights. They depend on key, seed and replicate alone."""
    draws = (h[:, None] * a + c) % PRIME
    weights = np.zeros(draws.shape, dtype=np.uint8)
    for step in poisson_steps():
        weights += draws >= step
    return weights


#: Rows weighted at a time, groups a task holds before it sends their sums, and tasks that may share a group.
_ROWS, _GROUPS, _SALTS = 1000, 1000, 64


def _summed(sets: Sequence[Sequence[str]], columns: Sequence[str], values: Sequence[str], resamples: int, seed: int, schema: pa.Schema):
    """mapInArrow: for each group of each grouping the sums over a task's rows, one record with an array over replicates for each sum."""
    a, c = replicate_constants(resamples, seed)

    def records(sums: dict) -> pa.RecordBatch:
        names, arrays = list(sums), list(sums.values())
        ends = pa.array(np.arange(len(names) + 1, dtype=np.int32) * resamples)
        keys = [pa.array([n[0] for n in names], pa.int32())] + [pa.array([n[1][i] for n in names], schema.field(i + 1).type) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays(
            [*keys, *[pa.ListArray.from_arrays(ends, np.concatenate([s[:, k] for s in arrays])) for k in range(len(values) + 1)]],
            ["grouping", *columns, "w", *values],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            keys = list(zip(*[batch.column(name).to_pylist() for name in columns], strict=True)) if columns else [()] * batch.num_rows
            numbers: dict = {}
            group = np.array([numbers.setdefault(k, len(numbers)) for k in keys], dtype=np.int64)
            h = batch.column("_h").to_numpy(zero_copy_only=False)
            x = np.stack([np.ones(len(h)), *[batch.column(v).to_numpy(zero_copy_only=False) for v in values]], 1)
            order = np.argsort(group, kind="stable")
            for at in range(0, len(order), _ROWS):
                chosen = order[at : at + _ROWS]
                weights = poisson_weights(h[chosen], a, c).astype(np.float64)
                edges = np.flatnonzero(np.diff(group[chosen], prepend=-1, append=-1))
                names = list(numbers)
                for start, end in zip(edges, edges[1:], strict=False):
                    found, name = weights[start:end].T @ x[chosen[start:end]], names[group[chosen[start]]]
                    for place, held in enumerate(sets):
                        to = (place, tuple(v if n in held else None for n, v in zip(columns, name, strict=True)))
                        sums[to] = sums[to] + found if to in sums else found
            if len(sums) > _GROUPS:
                yield records(sums)
                sums = {}
        if sums:
            yield records(sums)

    return run


def replicate_sums(rows: DataFrame, sets: Sequence[Sequence[str]], values: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """(grouping, columns of the groupings, replicate, w, values): the sums of weights and weighted values in every replicate.

    ``rows`` has the columns of the groupings, ``_h`` (see ``row_hash``) and the values, none of them null. The weights of a batch of rows are one
    matrix, which a task sums for every grouping at once; what leaves a task are sums, at most as many as it has groups times
    replicates. Only the narrow rows are shuffled before, each group over at most ``_SALTS`` tasks.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    kinds = [rows.schema[c].dataType for c in columns]
    schema = T.StructType(
        [T.StructField("grouping", T.IntegerType()), *[T.StructField(c, k) for c, k in zip(columns, kinds, strict=True)]]
        + [T.StructField(v, T.ArrayType(T.DoubleType())) for v in ("w", *values)]
    )
    dealt = spread(rows.select(*columns, "_h", *[F.col(v).cast("double").alias(v) for v in values]), *columns, F.pmod("_h", F.lit(_SALTS)))
    sums = dealt.mapInArrow(_summed(sets, columns, values, resamples, seed, to_arrow_schema(schema)), schema)
    each = sums.select("grouping", *columns, F.posexplode(F.arrays_zip("w", *values)).alias("replicate", "s"))
    return each.groupBy("grouping", *columns, "replicate").agg(*[F.sum(F.col("s")[v]).alias(v) for v in ("w", *values)])


def percentiles(means: Column, percent: tuple[float, float] = (2.5, 97.5)) -> tuple[Column, Column]:
    """Both ends of the percentile interval of an array of replicate means; null for an empty one."""
    ordered, n = F.array_sort(means), F.size(means)
    low = F.greatest(F.lit(0), F.floor(n * F.lit(percent[0] / 100)).cast("int") - 1)
    high = F.least(n - 1, F.floor(n * F.lit(percent[1] / 100)).cast("int"))
    return F.when(n > 0, F.get(ordered, low)), F.when(n > 0, F.get(ordered, high))


def bootstrap_interval(
    scored: DataFrame,
    key: str,
    groups: Sequence[str],
    values: Sequence[str],
    resamples: int = K.BOOTSTRAP_RESAMPLES,
    seed: int = K.SEED,
    percent: tuple[float, float] = (2.5, 97.5),
) -> DataFrame:
    """Percentile interval of each value's mean, per group; groups under two samples have none.

    A replicate gives every row a Poisson(1) weight, the limit of drawing as many rows with replacement. The weight follows from the hash of the
    row's key and two constants of the replicate, so nothing is looked up or joined (see ``replicate_sums``). A
    replicate in which no row has weight has no mean and is left out.
    """
    groups = list(groups)
    rows = stage(scored.select(*groups, *values, row_hash(F.col(key), seed).alias("_h")))
    enough = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n")
    whole = replicate_sums(rows, [groups], values, resamples, seed).groupBy(*groups).agg(
        *[F.collect_list(F.when(F.col("w") > 0, F.col(v) / F.col("w"))).alias(f"_{v}") for v in values]
    )
    ends = [end.alias(f"{v}_{name}") for v in values for name, end in zip(("low", "high"), percentiles(F.col(f"_{v}"), percent), strict=True)]
    return whole.join(enough, groups, "left_semi").select(*groups, *ends)


#: Rows a task of :func:`drawn_interval` holds to look draws up in: up to twice as many, as pieces of groups are kept whole.
HELD = 8_000_000


def _drawn(columns: Sequence[str], values: Sequence[str], edges: Sequence[int], seed: int, schema: pa.Schema):
    """mapInArrow: over the rows of a block of positions, for each group with rows in it and each replicate of the share ``_share`` the number and sum of the values drawn there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per group: its number of rows, the positions held here and their values
        parts: dict = {}
        share = None
        for batch in batches:
            if not batch.num_rows:
                continue
            share = batch.column("_share")[0].as_py()
            keys = list(zip(*[batch.column(name).to_pylist() for name in columns], strict=True)) if columns else [()] * batch.num_rows
            numbers: dict = {}
            group = np.array([numbers.setdefault(k, len(numbers)) for k in keys], dtype=np.int64)
            position, n = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("position", "n"))
            # (where it is known, unless it always is, and the value)
            held = [
                (batch.column(v).is_valid().to_numpy(zero_copy_only=False) if batch.column(v).null_count else None, batch.column(v).fill_null(0.0).to_numpy(zero_copy_only=False))
                for v in values
            ]
            for key, at in numbers.items():
                mine = np.flatnonzero(group == at) if len(numbers) > 1 else slice(None)
                rows = parts.setdefault(key, (int(n[mine][0]), []))[1]
                rows.append((position[mine].astype(np.int32 if n[0] < 1 << 31 else np.int64), [(None if ok is None else ok[mine], x[mine].copy()) for ok, x in held]))
        if share is None:
            return
        replicates = range(edges[share], edges[share + 1])
        draws = Draws(seed, replicates)
        for key in list(parts):
            n, rows = parts.pop(key)
            low, high = min(int(p.min()) for p, _ in rows), max(int(p.max()) for p, _ in rows) + 1
            # a position without a row here (another block has it) and a null count nothing
            every = sum(len(p) for p, _ in rows) == high - low and all(ok is None for _, held in rows for ok, _ in held)
            there = None if every else np.zeros((len(values), high - low), np.bool_)
            value = np.zeros((len(values), high - low))
            while rows:
                position, held = rows.pop()
                for k, (ok, x) in enumerate(held):
                    value[k, position - low] = x
                    if there is not None:
                        there[k, position - low] = True if ok is None else ok
            count, total = np.zeros((len(values), len(replicates))), np.zeros((len(values), len(replicates)))
            for start in range(0, n, _SLOTS):
                for _, drawn in draws.of([b"%d" % slot for slot in range(start, min(n, start + _SLOTS))]):
                    place = np.floor(drawn * (1.0 / (1 << 52)) * n).astype(np.int64) - low
                    inside = np.True_ if low == 0 and high == n else (place >= 0) & (place < high - low)
                    if inside is not np.True_:
                        place[~inside] = 0
                    for k in range(len(values)):
                        found = value[k].take(place)
                        if inside is not np.True_:
                            found *= inside
                        total[k] += found.sum(0)
                        count[k] += (inside & there[k].take(place)).sum(0) if there is not None else len(place) if inside is np.True_ else inside.sum(0)
            arrays = [pa.array([v] * len(replicates), schema.field(i).type) for i, v in enumerate(key)]
            arrays.append(pa.array(list(replicates), pa.int32()))
            for k in range(len(values)):
                arrays += [pa.array(count[k]), pa.array(total[k])]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return run


#: Slots of a replicate whose names are made at a time.
_SLOTS = 100_000


def _blocks(placed: DataFrame, groups: Sequence[str], rows: int) -> tuple[DataFrame, int]:
    """``placed`` with the number of its block in ``_block``, and how many blocks there are: pieces of at most ``HELD`` positions of a group, and many small groups, share one."""
    if rows <= HELD:
        return placed.withColumn("_block", F.lit(0).cast("bigint")), 1
    cut = placed.withColumn("_piece", F.floor(F.col("position") / F.lit(HELD)))
    sizes = cut.groupBy(*groups, "_piece").agg(F.count(F.lit(1)).alias("_rows"))
    # one row for each group and each HELD rows
    before = F.sum("_rows").over(Window.orderBy(*groups, "_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    dealt = sizes.select(*groups, "_piece", F.floor(before / F.lit(HELD)).alias("_block"))
    return stage(cut.join(dealt, [*groups, "_piece"]).drop("_piece")), rows // HELD + 1


def drawn_interval(
    scored: DataFrame,
    key: str,
    groups: Sequence[str],
    values: Sequence[str],
    resamples: int = K.BOOTSTRAP_RESAMPLES,
    seed: int = K.SEED,
    percent: tuple[float, float] = (2.5, 97.5),
) -> DataFrame:
    """Percentile interval of each value's mean, per group, over replicates of exactly as many rows drawn with replacement; groups under two samples have none.

    Every row stands for one slot of every replicate and draws the position it is filled from. A task makes the draws of some replicates
    and reads the values they land on in arrays, so neither draws nor drawn rows are shuffled: only the sums of a replicate leave it. Every task
    reads the rows from the staged files. Beyond ``HELD`` rows they are cut into blocks, and the draws are made again for
    each block of a group: what a task holds does not grow with the table.
    """
    groups = list(groups)
    placed = stage(
        shuffled_position(scored, key, seed, groups).where("n >= 2").select(
            *groups, F.col("position").cast("bigint").alias("position"), F.col("n").cast("bigint").alias("n"), *[F.col(v).cast("double").alias(v) for v in values]
        )
    )
    cut, blocks = _blocks(placed, groups, placed.count())
    schema = T.StructType(
        [*[T.StructField(g, placed.schema[g].dataType) for g in groups], T.StructField("replicate", T.IntegerType())]
        + [T.StructField(f"_{kind}_{v}", T.DoubleType()) for v in values for kind in ("n", "s")]
    )
    arrow = to_arrow_schema(schema)
    # more shares than cores, so that a slow one does not hold up the rest
    shares = max(1, min(resamples, -(-3 * scored.sparkSession.sparkContext.defaultParallelism // blocks)))
    edges = [resamples * i // shares for i in range(shares + 1)]
    # one task for each share and block, which streams the block's files past the share's only row: a product without a shuffle
    dealt = scored.sparkSession.range(0, shares, 1, shares).select(F.col("id").alias("_share"))
    each = [cut.filter(F.col("_block") == block).drop("_block").coalesce(1).hint("shuffle_replicate_nl").crossJoin(dealt) for block in range(blocks)]
    sums = reduce(DataFrame.unionAll, each).mapInArrow(_drawn(groups, values, edges, seed, arrow), schema)
    means = sums.groupBy(*groups, "replicate").agg(*[F.try_divide(F.sum(f"_s_{v}"), F.sum(f"_n_{v}")).alias(v) for v in values])
    whole = means.groupBy(*groups).agg(*[F.collect_list(v).alias(f"_{v}") for v in values])
    ends = [end.alias(f"{v}_{name}") for v in values for name, end in zip(("low", "high"), percentiles(F.col(f"_{v}"), percent), strict=True)]
    return whole.select(*groups, *ends)
