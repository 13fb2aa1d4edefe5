"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

The codebooks are fitted by rounds of assigning every part to its nearest entry and moving the entries to the means. From one
round to the next most parts stay where they are, and bounds show it without computing distances. For every part and group of
entries a row keeps the least distance to the entries of the group (the assigned one aside) and the round in which
it was measured. All earlier codebooks are kept, so in a later round the bound is that distance less the largest *net*
displacement of an entry of the group between the two rounds: the norm of the sum of its moves, which is never more than the
sum of the norms that bounds carried along from round to round would have to subtract. Only groups whose bound
does not exceed the exact distance to the assigned entry are measured again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import bounded_broadcast, release, small_batches
from gridcast.llm.vectors import lists, matrix, whole_vectors
from gridcast.session import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Entries that share a bound.
GROUP = 8
#: Bounds are lowered by this share, far more than the rounding of their square roots.
SLACK = 1e-9

_FAR = np.iinfo(np.int64).max
STATE = "id long, label int, x array<int>, code array<int>, least array<float>, stamp array<byte>, error long"


def displacements(history: np.ndarray, group: int = GROUP) -> np.ndarray:
    """[round, part, group]: the largest distance between where an entry of the group stood in that round and where it stands now."""
    net = np.sqrt(((history - history[-1]) ** 2).sum(-1).astype(np.float64))
    return np.stack([net[:, :, at : at + group].max(-1) for at in range(0, net.shape[2], group)], -1)


def assign(x: np.ndarray, history: np.ndarray, code: np.ndarray, least: np.ndarray, stamp: np.ndarray, group: int = GROUP) -> tuple:
    """One round for rows ``x`` [row, part, position]: (code, least, stamp, error, groups measured).

    ``history`` [round, part, entry, position] ends with the codebooks to assign to. ``code`` [row, part] is the earlier
    assignment, ``least`` and ``stamp`` [row, part, group] the distances to the other entries and their rounds; a
    negative stamp means never measured. Integer distances decide, ties go to the lower index.
    """
    now, moved = len(history) - 1, displacements(history, group)
    n, parts = code.shape
    entries, groups = history.shape[2], least.shape[2]
    code, least, stamp, error, measured = code.copy(), least.copy(), stamp.copy(), np.zeros(n, dtype=np.int64), 0
    rows = np.arange(n)
    for p in range(parts):
        book, own = history[-1, p], code[:, p].astype(np.int64)
        reach = ((x[:, p] - book[own]) ** 2).sum(-1)
        old = stamp[:, p].astype(np.int64)
        drift = moved[:, p, :][np.maximum(old, 0), np.arange(groups)]
        bound = (least[:, p].astype(np.float64) - drift) * (1 - SLACK)
        look = (old < 0) | (bound <= np.sqrt(reach.astype(np.float64))[:, None] * (1 + SLACK))
        distance = np.full((n, entries), _FAR, dtype=np.int64)

        def measure(g: int, chosen: np.ndarray) -> None:
            part = book[g * group : (g + 1) * group]
            distance[chosen, g * group : g * group + len(part)] = ((x[chosen, p][:, None, :] - part[None]) ** 2).sum(-1)

        for g in range(groups):
            measure(g, np.flatnonzero(look[:, g]))
        distance[rows, own] = reach
        new = distance.argmin(1)
        error += distance[rows, new]
        # The entry that was left now belongs to the others of its group, which have to be measured with it.
        left = np.flatnonzero((new != own) & ~look[rows, own // group])
        for g in np.unique(own[left] // group).tolist():
            measure(g, left[own[left] // group == g])
        look[left, own[left] // group] = True
        distance[rows, new] = _FAR
        for g in range(groups):
            chosen = np.flatnonzero(look[:, g])
            near = distance[chosen, g * group : (g + 1) * group].min(1)
            root = np.sqrt(near.astype(np.float64)).astype(np.float32)
            least[chosen, p, g] = np.where(near == _FAR, np.float32(np.inf), np.nextafter(root, np.float32(0)))
            stamp[chosen, p, g] = now
        measured += int(look.sum())
        code[:, p] = new
    return code, least, stamp, error, measured


def _round(history: np.ndarray, group: int):
    """mapInArrow: the state of each row after assigning to the last codebooks of ``history``."""
    parts, entries, width = history.shape[1:]
    groups = -(-entries // group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), parts * width).astype(np.int64).reshape(-1, parts, width)
            if len(history) == 1:
                code = np.zeros((len(x), parts), dtype=np.int32)
                least, stamp = np.zeros((len(x), parts, groups), dtype=np.float32), np.full((len(x), parts, groups), -1, dtype=np.int8)
            else:
                code = matrix(batch.column("code"), parts)
                least, stamp = (matrix(batch.column(c), parts * groups).reshape(-1, parts, groups) for c in ("least", "stamp"))
            code, least, stamp, error, _ = assign(x, history, code, least, stamp, group)
            flat = (len(x), parts * groups)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("x"), lists(code, pa.int32()), lists(least.reshape(flat), pa.float32()), lists(stamp.reshape(flat), pa.int8()), pa.array(error)],
                ["id", "label", "x", "code", "least", "stamp", "error"],
            )

    return run


def _sums(parts: int, entries: int, width: int):
    """mapInArrow: per task the number of parts of each entry and their sums, at most one row for each entry and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, dtype=np.int64), np.zeros((parts * entries, width), dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), parts * width).astype(np.int64).reshape(-1, width)
            slot = (matrix(batch.column("code"), parts) + np.arange(parts) * entries).reshape(-1)
            count += np.bincount(slot, minlength=len(count))
            np.add.at(total, slot, x)
        slot, place = (a.reshape(-1) for a in np.meshgrid(np.flatnonzero(count), np.arange(width), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(place), pa.array(count[slot]), pa.array(total[slot, place])], ["slot", "place", "n", "total"])

    return run


def moved_entries(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after every entry moved to the floor of the mean of its parts; unused entries stay.

    A task sends one row for each entry and position; only their sums, as many as the codebooks have numbers, reach the driver.
    """
    parts, entries, width = books.shape
    sums = state.select("x", "code").mapInArrow(_sums(parts, entries, width), "slot long, place long, n long, total long")
    books = books.copy()
    for r in sums.groupBy("slot", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        books[r["slot"] // entries, r["slot"] % entries, r["place"]] = int(r["total"]) // r["n"]
    return books


def first_books(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids (nulls last; of one id, the smaller vector first): fewer entries where there are fewer rows."""
    chosen = rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    return np.array([r["x"] for r in chosen], dtype=np.int64).reshape(-1, parts, width).transpose(1, 0, 2)


CODES = "id long, label int, code array<int>, error long"


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, group: int = GROUP) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors, (id, label, code: array<int> of entry numbers, error), and the codebooks [part, entry, position].

    Components become floor(256 * x). A row takes no part if its vector is null or empty, holds a null, NaN, infinity or a
    number that cannot be squared exactly (see ``vectors.usable``), or is not as long as that of the smallest id; rows beside these
    give one row each, repeated rows too. The length must be a multiple of ``parts``. Null ids come last among the first entries, null
    labels are kept. Equal distances go to the lower index, and entries that are equal (repeated vectors among the
    first) leave all parts to the lowest of them. Other columns are not read, whatever their names. An empty table, or one
    without usable rows, gives no rows and codebooks without entries.

    The state of a row (code, bounds and their rounds) is written after each round and read by the next, so a lost executor
    costs the tasks of one round. Executors hold a batch; the driver holds the codebooks of all rounds.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows, length = whole_vectors(df.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).alias("v")), "vec", "v", F.col("label"))
    if not length:
        return spark.createDataFrame([], CODES), np.zeros((parts, 0, 0), dtype=np.int64)
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    state = stage(rows.select("id", "label", "x"))
    history = first_books(state, parts, entries, length // parts)[None]
    for done in range(rounds + 1):
        before, state = state, stage(state.mapInArrow(_round(history, group), STATE))
        release(before)
        if done < rounds:
            history = np.concatenate([history, moved_entries(state, history[-1])[None]])
    return state.select("id", "label", "code", "error"), history[-1]


def reconstruct(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with ``x``: the entries a code names, one after the other. The codebooks travel with the plan; they do not grow with the data."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in entry]) for entry in part]) for part in books.tolist()])
    return codes.withColumn("x", F.flatten(F.transform("code", lambda c, p: table[p][c])))


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Add ``label_error``, the sum of the errors of all rows of the same label, null being one. Summed on the map side; a few labels are broadcast."""
    sums = stage(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"))
    return codes.join(bounded_broadcast(sums, sums.count()), F.col("label").eqNullSafe(F.col("same")), "left").drop("same")
