"""Quality scores by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.common import hash60, release, small_batches
from gridcast.session import stage

#: Labelled documents of a block, about, and blocks at most: pairs are made inside blocks, and a step of the fit returns one set of sums a block.
BLOCK, BLOCKS = 1000, 4096
#: Documents of the rarer label a block should have; where there are fewer, each goes to several blocks.
PARTNERS = 50
#: Preference pairs of each document of the more frequent label.
ROUNDS = 3
#: Pull of the weights to zero.
RIDGE = 1e-3
#: Ids are filtered by a bit for each residue of their hash before features are made.
RESIDUES = 1 << 24
#: The threshold is one of so many quantiles of the labelled scores, which are counted in so many bins.
QUANTILES, BINS = 200, 1 << 16

_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[list(range(0x61, 0x7B))] = 1
_KINDS[list(range(0x41, 0x5B))] = 2
_KINDS[list(range(0x30, 0x3A))] = 3
_KINDS[[0x20, *range(9, 14)]] = 4
_KINDS[list(range(0x80, 256))] = 5
_KINDS[[0x2C, 0x2E]] = 6
_KINDS[[0x27, 0x22, 0x28, 0x29, 0x2D, 0x3A, 0x3B, 0x3F]] = 7
_NAMES = (
    "log_words word_length upper digit mark other_mark repeated_mark distinct_words top_word repeat_next distinct_lines short_lines "
    "line_words marked_words capital_words stops_per_word distinct_triples wide empty"
).split()


def features(text: str | None) -> np.ndarray:
    """Shares and logarithms that describe the whole text; nothing but the text is looked at.

    A null, empty or blank text has all zeros but the last, ``empty``.
    """
    out = np.zeros(len(_NAMES))
    data = b"" if text is None else text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        out[-1] = 1
        return out
    raw = np.frombuffer(data, dtype=np.uint8)
    kinds = np.bincount(_KINDS[raw], minlength=8).astype(float)
    solid = kinds.sum() - kinds[4]
    n = len(words)
    lower = data.lower().split()
    counts: dict[bytes, int] = {}
    for w in lower:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    odd = _KINDS[raw] == 0
    out[0] = np.log1p(n)
    out[1] = np.log(solid / n)
    out[2] = kinds[2] / max(1.0, kinds[1] + kinds[2])
    out[3] = kinds[3] / solid
    out[4] = (kinds[6] + kinds[7]) / solid
    out[5] = kinds[0] / solid
    out[6] = float((odd[1:] & odd[:-1] & (raw[1:] == raw[:-1])).sum()) / solid
    out[7] = len(counts) / n
    out[8] = max(counts.values()) / n
    out[9] = sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / n
    out[10] = len(set(lines)) / len(lines)
    out[11] = sum(len(x) < 30 for x in lines) / len(lines)
    out[12] = np.log1p(n / len(lines))
    out[13] = sum(_KINDS[w[-1]] == 0 for w in words) / n
    out[14] = sum(0x41 <= w[0] <= 0x5A for w in words) / n
    out[15] = kinds[6] / n
    triples = max(1, n - 2)
    out[16] = len(set(zip(lower, lower[1:], lower[2:], strict=False))) / triples
    out[17] = kinds[5] / solid
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def feature_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([features(t) for t in texts], dtype=object)


@dataclass(frozen=True)
class Ranking:
    """Scores z = weights . (x - mean) / scale; a document is accepted if z reaches the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """In 0 to 1, at least 0.5 exactly where the threshold is reached."""
        z = ((x - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pair_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs, slope and curvature of their logistic loss, in one row."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    return np.concatenate([[len(d)], d.T @ (p - 1), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], size: int, ridge: float, steps: int) -> np.ndarray:
    w = np.zeros(size)
    for _ in range(steps):
        found = sums(w)
        n, slope, curve = found[0], found[1 : size + 1], found[size + 1 :].reshape(size, size)
        slope = slope / n + ridge * w
        if np.abs(slope).max() < 1e-8:
            break
        w = w - np.linalg.solve(curve / n + ridge * np.eye(size), slope)
    return w


def fit_pairs(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Weights that minimise the mean logistic loss of w . (better - worse), by Newton steps."""
    return _newton(lambda w: _pair_sums(better - worse, w), better.shape[1], ridge, steps)


#: What a step does with one block: (features, labels, whether the row counts here) -> a row of numbers.
Step = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _moments(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
    x, y = x[own], y[own]
    middle = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    return np.concatenate([[len(x), y.sum()], middle, ((x - middle) ** 2).sum(axis=0)])


def _differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Good less bad, every row of a block in ``ROUNDS`` pairs at least: the rarer label is gone through in turn."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return np.zeros((0, x.shape[1]))
    i = np.arange(max(len(good), len(bad)))
    return np.concatenate([good[(i + r * (len(good) < len(bad))) % len(good)] - bad[(i + r * (len(good) >= len(bad))) % len(bad)] for r in range(ROUNDS)])


def fit(each: Callable[[Step], list[np.ndarray]], added: Callable[[Step], np.ndarray]) -> Ranking:
    """Learn from blocks of features and labels 0/1. Without both labels there is no preference: all scores are 0.5.

    ``each`` gives the result of a step for every block, in a fixed order, so that sums come out the same each time; ``added`` the sum of whole
    numbers over the blocks. Every block counts in every step: no row is left out.
    """
    size = len(_NAMES)
    n, goods, mean, square = 0.0, 0.0, np.zeros(size), np.zeros(size)
    for row in each(_moments):
        m, middle = row[0], row[2 : size + 2]
        if m:
            gap = middle - mean
            mean, square = mean + gap * m / (n + m), square + row[size + 2 :] + gap**2 * n * m / (n + m)
            n, goods = n + m, goods + row[1]
    scale = np.sqrt(square / max(n, 1))
    scale[scale < 1e-9] = 1
    if not goods or goods == n:
        return Ranking(mean, scale, np.zeros(size), 0.0)
    w = _newton(lambda w: np.sum(each(lambda x, y, own: _pair_sums(_differences((x - mean) / scale, y), w)), axis=0), size, RIDGE, 50)

    def scores(x: np.ndarray) -> np.ndarray:
        return ((x - mean) / scale) @ w

    ends = np.array(each(lambda x, y, own: np.array([scores(x[own]).min(), scores(x[own]).max()]) if own.any() else np.array([np.inf, -np.inf])))
    low, high = ends[:, 0].min(), ends[:, 1].max()
    width = (high - low) / (BINS - 1) or 1.0

    def counted(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
        bins = np.clip(((scores(x[own]) - low) / width).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(bins[y[own] == label], minlength=BINS) for label in (0, 1)])

    bad, good = added(counted).reshape(2, BINS)
    full = np.flatnonzero(bad + good)
    below = np.concatenate([[0], np.cumsum((bad + good)[full])])[:-1]
    right = np.concatenate([[0], np.cumsum(bad[full])])[:-1] + goods - np.concatenate([[0], np.cumsum(good[full])])[:-1]
    levels = np.unique(np.searchsorted(below, np.arange(1, QUANTILES) / QUANTILES * (n - 1), side="right") - 1)
    best = [i for i in levels if right[i] == right[levels].max()]
    at = best[len(best) // 2]
    # in the middle of the empty bins below that of the quantile, so that no score lies on the threshold
    return Ranking(mean, scale, w, float(low + width * ((full[at] + full[at - 1] + 1) / 2 if at else full[at])))


def fit_ranking(x: np.ndarray, y: np.ndarray) -> Ranking:
    """The same fit on features and labels that are one block."""
    own = np.ones(len(x), dtype=bool)
    return fit(lambda f: [f(x, y, own)], lambda f: f(x, y, own))


def learnable(doc_id: Column) -> Column:
    """Rows that labels may be learned from; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None) -> Ranking:
    """Fit on all labelled documents that are not held out; with ``sample``, on about so many of them at most.

    Rows without id, label or document are left out. Of several labels of an id the lower counts, of several
    texts the one with the least features.

    Labelled features are dealt out by a hash of the id into blocks of bounded size, one row a block, and stay there: a step of the fit reads them
    once, shuffles nothing and returns one row of sums a block.
    """
    small_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).where("id IS NOT NULL AND quality IN (0, 1)").where(learnable(F.col("id")))
    usable = usable.groupBy("id").agg(F.min("quality").alias("quality"))
    if sample is not None and (total := usable.count()) > sample:
        # a 60-bit hash below the share: about ``sample`` rows, whatever the number of labels
        usable = usable.where(F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "id"), 4) < (sample << 60) // total)
    usable = stage(usable)
    # texts of most other documents leave by a filter of bounded size before their features are made; the join decides
    residue = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(RESIDUES))
    bit = lambda r: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(r, F.lit(64)).cast("int"))
    masks = usable.groupBy(F.shiftright(residue, 6).alias("word")).agg(F.bit_or(bit(residue)).alias("mask"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(learnable(F.col("id"))).withColumn("word", F.shiftright(residue, 6))
    found = texts.join(F.broadcast(masks), "word").where(F.col("mask").bitwiseAND(bit(residue)) != 0).select("id", feature_column("text").alias("x"))
    known = stage(found.join(usable, "id").groupBy("id", "quality").agg(F.min("x").alias("x")))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    blocks = max(1, min(BLOCKS, -(-sum(counts.values()) // BLOCK)))
    rare = min((0, 1), key=lambda k: (counts.get(k, 0), k))
    copies = min(blocks, -(-PARTNERS * blocks // max(1, counts.get(rare, 0))))
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == rare, F.lit(copies - 1)).otherwise(F.lit(0))))
    dealt = known.select("*", copy.alias("copy")).select("*", F.pmod(hash60(F.lit("block"), F.col("id")) + F.col("copy") * (blocks // copies), F.lit(blocks)).alias("block"))
    rows = F.array_sort(F.collect_list(F.struct("id", "copy", "quality", "x"))).alias("rows")
    packed = dealt.groupBy("block").agg(rows).select("block", F.col("rows.quality").alias("y"), (F.transform("rows.copy", lambda c: c == 0)).alias("own"), F.flatten("rows.x").alias("x"))
    packed = stage(packed)
    release(known)
    release(usable)

    def arrays(batch: pd.DataFrame):
        for block, y, own, x in zip(batch["block"], batch["y"], batch["own"], batch["x"], strict=True):
            yield block, np.asarray(x, dtype=float).reshape(-1, len(_NAMES)), np.asarray(y, dtype=np.int64), np.asarray(own, dtype=bool)

    def each(step: Step) -> list[np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([(block, step(x, y, own)) for block, x, y, own in arrays(batch)], columns=["block", "v"])

        return [np.array(r["v"]) for r in sorted(packed.mapInPandas(run, "block long, v array<double>").collect(), key=lambda r: r["block"])]

    def added(step: Step) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum((step(x, y, own) for batch in batches for _, x, y, own in arrays(batch)), np.zeros(1, dtype=np.int64))
            places = np.flatnonzero(total)
            yield pd.DataFrame({"place": places, "v": total[places]})

        out = np.zeros(2 * BINS)
        for r in packed.mapInPandas(run, "place long, v long").groupBy("place").agg(F.sum("v").alias("v")).collect():
            out[r["place"]] = r["v"]
        return out

    model = fit(each, added)
    release(packed)
    return model


def score_column(text: Column, model: Ranking) -> Column:
    """Quality of ``text`` in 0 to 1, of its whole text; one value for all null, empty and blank texts."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts]) if len(texts) else np.zeros((0, len(model.mean)))
            yield pd.Series(model.score(x))

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= 0.5, else 0).

    Bradley-Terry: of a pair of labelled documents, the good one is preferred; weights are learned by logistic
    loss on the difference of features, and the acceptance threshold is the quantile of the labelled scores that
    splits the labels best. Both see every usable label (``sample`` bounds them on request); the scores cover every row and the
    whole text in one pass without a shuffle. A null id is not held out. Rows of one text
    have one score. Without usable labels every score is 0.5. An empty table gives none. Other
    columns, whatever their names, are not read.
    """
    model = learn(docs, labels, id_col, text_col, sample)
    small_batches(docs.sparkSession)
    held_out = F.coalesce(~learnable(F.col(id_col)), F.lit(False))
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), score_column(F.col(text_col), model).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected."""
    model = learn(docs, labels, id_col, text_col, sample)
    small_batches(docs.sparkSession)
    return docs.where(score_column(F.col(text_col), model) >= 0.5)
