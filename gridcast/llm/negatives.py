"""Hard negatives by angular triangle filtering.

Every row stores its norm and its angles to a few reference directions. By the triangle inequality on the sphere, the angle between an anchor
a and a row x lies between |A - X| and min(A + X, 360 degrees - A - X) for the angles A and X of both to any
reference; the cosines of the best of these limits, times both norms, bound the score from both sides. They are widened by far more than
rounding can cost. Only rows whose bounds reach into what is looked for are scored, with whole numbers.

Positives: rows whose upper bound reaches the fifth best lower bound. Negatives: rows whose bounds overlap the window of scores of a
positive. The anchors are the query set; they meet the rows in blocks of bounded size on both sides, first of their own label, then of the cells
(rows by nearest reference) whose common bounds overlap a window at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import bounded_broadcast, free_name, on_files, release, small_batches, with_row_key
from gridcast.llm.vectors import lists, matrix, whole_vectors
from gridcast.session import stage

#: Reference directions, and how many rows they are chosen from.
REFERENCES, SAMPLE = 8, 1024
#: Rows and anchors that meet in one group.
ROWS, ANCHORS = 4096, 2048
POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least this share of its positive, in percent.
FLOOR = 80
#: Angles are widened by this many radians, scores by this share and this much; arccos loses 3e-8 at most.
ANGLE, SHARE, MUCH = 1e-6, 1e-9, 1e-3
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 52)


def references(sample: np.ndarray, wanted: int = REFERENCES) -> np.ndarray:
    """Unit vectors of up to ``wanted`` rows of ``sample``: each next one has the largest angle to those chosen (the first of ties). A unit axis if all are zero."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.eye(1, sample.shape[1])
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < wanted and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def angles(x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles to the references); a zero vector is at right angles to everything."""
    norms = np.linalg.norm(x, axis=1)
    cosine = (x @ refs.T) / np.maximum(norms, 1e-300)[:, None]
    return norms, np.arccos(np.clip(cosine, -1, 1))


def score_bounds(norm: np.ndarray, turn: np.ndarray, least: tuple[np.ndarray, np.ndarray], most: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[anchor, row]: bounds of the score of anchors (norm, angles ``turn``) with rows, or cells of rows, whose norms and angles lie from ``least`` to ``most``."""
    shape = (len(norm), len(least[0]))
    near, far = np.zeros(shape), np.full(shape, np.pi)
    for r in range(turn.shape[1]):
        a, low, high = turn[:, r, None], least[1][None, :, r], most[1][None, :, r]
        np.maximum(near, np.maximum(a - high, low - a), out=near)
        up = a + high
        up = np.where((a + low <= np.pi) & (up > np.pi), np.pi, np.minimum(np.maximum(up, a + low), 2 * np.pi - a - low))
        np.minimum(far, up, out=far)
    top, bottom = np.cos(np.maximum(near - ANGLE, 0)), np.cos(np.minimum(far + ANGLE, np.pi))
    low_norm, high_norm = norm[:, None] * least[0][None], norm[:, None] * most[0][None]
    upper = np.where(top > 0, top * high_norm, top * low_norm)
    lower = np.where(bottom > 0, bottom * low_norm, bottom * high_norm)
    slack = high_norm * SHARE + MUCH
    return lower - slack, upper + slack


def scores(anchor: np.ndarray, rows: np.ndarray, size: float) -> np.ndarray:
    """Inner products, exact: in doubles where norms (their product is ``size``) allow it, else in 64-bit integers."""
    if size < EXACT:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return (rows.astype(np.int64) * anchor.astype(np.int64)).sum(1)


def _first(score: np.ndarray, ids: np.ndarray, unknown: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: higher scores first, then smaller ids, null ids last."""
    if len(score) > 4 * k:  # leave those that cannot be among them
        cut = -np.partition(-score, k - 1)[k - 1]
        keep = np.flatnonzero(score >= cut)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], unknown[keep], -score[keep]))[:k]]


class _Side:
    """Rows of a group as matrices."""

    def __init__(self, table: pa.Table, width: int, refs: int):
        column = lambda name: table.column(name).combine_chunks()
        self.n = table.num_rows
        self.file, self.row = (column(c).to_numpy(zero_copy_only=False) for c in ("file", "row"))
        ids = column("id")
        self.unknown = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int8)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.label = column("label").to_numpy(zero_copy_only=False)
        self.norm = column("norm").to_numpy(zero_copy_only=False)
        self.turn = matrix(table.column("turn"), refs)
        self.x = matrix(table.column("x"), width)

    def known(self, places: np.ndarray) -> list:
        return [None if self.unknown[i] else int(self.ids[i]) for i in places]


POSITIVE = "a_file long, a_row long, id long, score long"
NEGATIVE = "a_file long, a_row long, positive int, id long, score long"


def _positives(width: int, refs: int, wanted: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _Side(left, width, refs), _Side(right, width, refs)
        out: list[list] = [[], [], [], []]
        for at in range(0, a.n if b.n else 0, 64):
            part = slice(at, at + 64)
            same = (a.file[part, None] == b.file[None]) & (a.row[part, None] == b.row[None])
            lower, upper = score_bounds(a.norm[part], a.turn[part], (b.norm, b.turn), (b.norm, b.turn))
            lower[same], upper[same] = -np.inf, -np.inf
            k = min(wanted, b.n)
            reached = np.partition(lower, b.n - k, axis=1)[:, b.n - k]
            for i in range(len(lower)):
                places = np.flatnonzero((upper[i] >= reached[i]) & ~same[i])
                score = scores(a.x[at + i], b.x[places], a.norm[at + i] * b.norm.max())
                best = _first(score, b.ids[places], b.unknown[places], wanted)
                out[0] += [a.file[at + i]] * len(best)
                out[1] += [a.row[at + i]] * len(best)
                out[2] += b.known(places[best])
                out[3] += score[best].tolist()
        return pa.table([pa.array(v, pa.int64()) for v in out], ["a_file", "a_row", "id", "score"])

    return run


def _negatives(width: int, refs: int, floor: int, wanted: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _Side(left, width, refs), _Side(right, width, refs)
        goals = left.column("goals").to_pylist()
        out: list[list] = [[], [], [], [], []]
        for at in range(0, a.n if b.n else 0, 64):
            lower, upper = score_bounds(a.norm[at : at + 64], a.turn[at : at + 64], (b.norm, b.turn), (b.norm, b.turn))
            for i in range(len(lower)):
                anchor, other = at + i, a.label[at + i] != b.label
                windows = sorted({g for g in goals[anchor] if g >= 0})
                overlaps = np.zeros(b.n, dtype=bool)
                for g in windows:
                    overlaps |= (upper[i] >= floor * g / 100 - MUCH) & (lower[i] <= g)
                places = np.flatnonzero(overlaps & other)
                score = scores(a.x[anchor], b.x[places], a.norm[anchor] * b.norm.max())
                found = {}
                for g in windows:
                    inside = np.flatnonzero((score >= -(-floor * g // 100)) & (score <= g))
                    found[g] = inside[_first(score[inside], b.ids[places[inside]], b.unknown[places[inside]], wanted)]
                for no, g in enumerate(goals[anchor]):
                    best = found.get(g, [])
                    out[0] += [a.file[anchor]] * len(best)
                    out[1] += [a.row[anchor]] * len(best)
                    out[2] += [no] * len(best)
                    out[3] += b.known(places[best]) if len(best) else []
                    out[4] += score[best].tolist() if len(best) else []
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["a_file", "a_row", "positive", "id", "score"])

    return run


def _placed(refs: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, turn = angles(matrix(batch.column("x"), width).astype(np.float64), refs)
            made = [pa.array(norm), lists(turn, pa.float64()), pa.array(turn.argmin(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "norm", "turn", "cell"])

    return run


POINT = "id long, file long, row long, label int, query boolean, x array<int>, norm double, turn array<double>, cell int"
AIMED = "file long, row long, id long, label int, x array<int>, norm double, turn array<double>, goals array<long>"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FIELDS = ["file", "row", "id", "label", "x", "norm", "turn"]


def _share(rows: Column | str, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((F.col(rows) if isinstance(rows, str) else rows) / most)).cast("int")


def _dealt(salt: int, parts: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "file", "row"), F.col(parts)).cast("int")


def _each(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _best(found: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    """The first ``wanted`` rows of each key, with their rank; limited on the map side first."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def _overlapping(cells: list, floor: int):
    """mapInArrow: each anchor once per cell whose bounds overlap one of its windows."""
    names = [c["cell"] for c in cells]
    least = np.array([c["least_norm"] for c in cells]), np.array([c["least_turn"] for c in cells])
    most = np.array([c["most_norm"] for c in cells]), np.array([c["most_turn"] for c in cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = batch.column("norm").to_numpy(zero_copy_only=False)
            lower, upper = score_bounds(norm, matrix(batch.column("turn"), least[1].shape[1]), least, most)
            chosen: tuple[list, list] = ([], [])
            for i, goals in enumerate(batch.column("goals").to_pylist()):
                for c, name in enumerate(names):
                    if any(g >= 0 and upper[i, c] >= floor * g / 100 - MUCH and lower[i, c] <= g for g in goals):
                        chosen[0].append(i)
                        chosen[1].append(name)
            taken = batch.take(pa.array(chosen[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(chosen[1], pa.int32())], [*batch.schema.names, "cell"])

    return run


def hard_negatives(df: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, floor: int = FLOOR, refs: int = REFERENCES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says which rows are queries and ``label`` what a row's label is, both over the columns of ``df``. Components become floor(256 * x);
    a score is the integer inner product with the anchor, higher first, then the smaller id (nulls last). An anchor's positives are its first
    ``positives`` other rows of its label; for each of them the first ``negatives`` rows of other labels come out whose score is at
    most the positive's and at least ``floor`` percent of it.

    Rows with a null label, a null or empty vector, or one with a component that is null, not finite or too large to be exact (``vectors.usable``)
    take no part, nor do vectors of another length than the smallest id's. Repeated rows are rows of their own: a copy of an anchor is one of
    its positives, and anchors with one id each give their rows. A null in ``anchor`` means no query. Columns not
    named are not read. An empty table, or an anchor without positives or without fitting negatives, gives none.

    References come from ``SAMPLE`` rows by a hash of their content; they only decide how much is scored, not the result. Groups hold
    ``ROWS`` rows and ``ANCHORS`` anchors at most on average, so a label or cell with any share of the rows is dealt out over many.
    """
    spark = df.sparkSession
    small_batches(spark)
    source = on_files(df)
    keyed = with_row_key(source, free_name(source, "place"))
    place = F.col(keyed.columns[-1])
    named = keyed.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).alias("v"), place.alias("place"), label.cast("int").alias("label"), F.coalesce(anchor, F.lit(False)).alias("query"))
    others = F.col("place.file").alias("file"), F.col("place.row").alias("row"), F.col("label"), F.col("query")
    rows, width = whole_vectors(named.where("label IS NOT NULL"), "vec", "v", *others)
    if not width:
        return spark.createDataFrame([], MINED)
    rows = stage(rows.select("id", "file", "row", "label", "query", "x"))
    picked = rows.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).collect()
    directions = references(np.array([r["x"] for r in picked], dtype=np.float64), refs)
    k = len(directions)
    points = stage(rows.mapInArrow(_placed(directions, width), POINT))
    release(rows)
    queries = stage(points.where("query"))

    # Positives: rows and anchors of one label, both in blocks.
    sizes = points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("m")).where("m > 0")
    sizes = stage(sizes.select("label", _share("n", ROWS).alias("slices"), _share("m", ANCHORS).alias("blocks")))
    small = bounded_broadcast(sizes, sizes.count())
    left = queries.join(small, "label").select(*_FIELDS, _dealt(1, "blocks").alias("block"), _each("slices").alias("slice"))
    right = points.join(small, "label").select(*_FIELDS, _dealt(0, "slices").alias("slice"), _each("blocks").alias("block"))
    keys = ["label", "slice", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_positives(width, k, positives), POSITIVE)
    own = stage(_best(met, ["a_file", "a_row"], positives))
    goals = own.groupBy("a_file", "a_row").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("g"))
    aimed = queries.join(goals, (F.col("file") == F.col("a_file")) & (F.col("row") == F.col("a_row")))
    aimed = aimed.select(*_FIELDS, F.col("g.score").alias("goals"))

    # Negatives: anchors and the cells that can hold some.
    turns = [f(F.col("turn")[r]) for f in (F.min, F.max) for r in range(k)]
    stats = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("least_norm"), F.max("norm").alias("most_norm"), F.array(*turns[:k]).alias("least_turn"), F.array(*turns[k:]).alias("most_turn"))
    cells = stats.collect()  # one row for each reference
    aimed = stage(aimed.mapInArrow(_overlapping(cells, floor), f"{AIMED}, cell int"))
    asked = {r["cell"]: r["m"] for r in aimed.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).collect()}
    if not asked:
        return spark.createDataFrame([], MINED)
    dealt = [(c["cell"], -(-c["n"] // ROWS), -(-asked[c["cell"]] // ANCHORS)) for c in cells if c["cell"] in asked]
    small = F.broadcast(spark.createDataFrame(dealt, "cell int, slices int, blocks int"))
    left = aimed.join(small, "cell").select("cell", *_FIELDS, "goals", _dealt(1, "blocks").alias("block"), _each("slices").alias("slice"))
    right = points.join(small, "cell").select("cell", *_FIELDS, _dealt(0, "slices").alias("slice"), _each("blocks").alias("block"))
    keys = ["cell", "slice", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_negatives(width, k, floor, negatives), NEGATIVE)
    found = _best(met, ["a_file", "a_row", "positive"], negatives)

    pairs = own.select("a_file", "a_row", (F.col("rank") - 1).alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = queries.select(F.col("file").alias("a_file"), F.col("row").alias("a_row"), F.col("id").alias("anchor_id"))
    out = found.select("a_file", "a_row", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(pairs, ["a_file", "a_row", "positive"]).join(named, ["a_file", "a_row"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
