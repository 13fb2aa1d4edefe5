"""Benchmark decontamination by a broadcast hash set of word windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.common import small_batches

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text whose windows are broadcast at once; a longer benchmark is scanned in several slices.
SLICE_BYTES = 16 << 20

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z become a-z, word bytes stay, all others become a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words(text: str | None) -> list[bytes]:
    """The normalised words, as bytes: runs of digits, ASCII letters (lower-cased) and all other characters above U+007F."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Windows:
    """Windows of one length: their word numbers, ordered by hash, and the items that hold each."""

    hashes: np.ndarray
    numbers: np.ndarray
    first: np.ndarray
    owners: np.ndarray


class WindowIndex:
    """The windows of some benchmark items as sorted hashes; every hash hit is verified word by word."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        held: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            length = min(window, len(ids))
            for i in range(len(ids) - length + 1 if ids else 0):
                held.setdefault(length, {}).setdefault(tuple(ids[i : i + length]), set()).add(place[name])
        for salt in range(64):
            codes = np.random.default_rng(salt).integers(0, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            self.codes, self.windows = codes, {}
            for length, found in held.items():
                numbers = np.array(list(found), dtype=np.int32).reshape(-1, length)
                hashes = self.rolled(codes[numbers.ravel()], length)[::length]
                order = np.argsort(hashes)
                owners = [sorted(x) for x in found.values()]
                counts = np.array([len(owners[i]) for i in order])
                self.windows[length] = Windows(hashes[order], numbers[order], np.concatenate([[0], np.cumsum(counts)]), np.array([x for i in order for x in owners[i]], dtype=np.int32))
            if all(len(np.unique(w.hashes)) == len(w.hashes) for w in self.windows.values()):
                return
        raise ValueError("no salt gives the windows distinct hashes")

    @staticmethod
    def rolled(codes: np.ndarray, length: int) -> np.ndarray:
        """Hash of each run of ``length`` word codes."""
        n = len(codes) - length + 1
        total = np.zeros(max(n, 0), dtype=np.uint64)
        for i in range(length):
            total = total * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
            total ^= total >> np.uint64(29)
        return total

    def find(self, text: str | None) -> tuple[int, list[list[int]], list[str]]:
        """(number of words, hit stretches of words as [first, end), names of items whose windows occur)."""
        found = words(text)
        n = len(found)
        numbers = np.fromiter(map(self.vocabulary.get, found, repeat(0)), dtype=np.int32, count=n)
        known = numbers > 0
        marks, items = np.zeros(n + 1, dtype=np.int32), set()
        for length, windows in self.windows.items():
            if n < length:
                continue
            # only runs of known words can hold a window
            run = np.concatenate([[0], np.cumsum(known)])
            at = np.flatnonzero(run[length:] - run[:-length] == length)
            if not len(at):
                continue
            hashes = self.hashes_at(numbers, at, length)
            place = np.searchsorted(windows.hashes, hashes)
            place[place == len(windows.hashes)] = 0
            same = windows.hashes[place] == hashes
            at, place = at[same], place[same]
            if len(at):
                real = (numbers[at[:, None] + np.arange(length)] == windows.numbers[place]).all(axis=1)
                at, place = at[real], place[real]
                np.add.at(marks, at, 1)
                np.add.at(marks, at + length, -1)
                for p in np.unique(place):
                    items.update(windows.owners[windows.first[p] : windows.first[p + 1]].tolist())
        hit = np.concatenate([[False], np.cumsum(marks[:-1]) > 0, [False]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(hit))
        return n, edges.reshape(-1, 2).tolist(), [self.names[i] for i in sorted(items)]

    def hashes_at(self, numbers: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        total = np.zeros(len(at), dtype=np.uint64)
        for i in range(length):
            total = total * np.uint64(0x9E3779B97F4A7C15) + self.codes[numbers[at + i]]
            total ^= total >> np.uint64(29)
        return total


def find_windows(index: Broadcast):
    """A column function: text -> struct(n_words, spans, items)."""

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([index.value.find(t) for t in texts], columns=["n_words", "spans", "items"])

    return found


def slices(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in pieces of at most ``most`` bytes (or one longer item), fetched one after the other."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    items = benchmark.select(name.alias("name"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    pieces = 1 + 2 * size // most
    piece = F.pmod(F.xxhash64("name", "text"), F.lit(pieces))
    for i in range(pieces):
        held, taken = [], 0
        for r in items.where(piece == i).toLocalIterator():
            if held and taken + len(r["text"].encode()) > most:
                yield held
                held, taken = [], 0
            held.append((r["name"], r["text"]))
            taken += len(r["text"].encode()) + 64
        if held:
            yield held


def contamination(text: Column, benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> Column:
    """A column struct(n_words, spans, items) for the documents' ``text``.

    Words are lower-cased runs of letters and digits. A window is ``window`` consecutive words of an item; an item of
    fewer words is one window; one without words has none. ``spans`` are the stretches [first, end) of document words that lie inside an
    occurrence of a window; ``items`` are the sorted ids, as strings, of items with an occurring window (a null id is the empty
    string). A null or empty text has no words. An item given twice counts once.

    The windows are broadcast as sorted hashes in slices of ``slice_bytes`` of benchmark text; the driver builds one slice at a time, but a
    task holds all of them, so the benchmark has to fit a worker. Documents are not shuffled.
    """
    spark = benchmark.sparkSession
    small_batches(spark)
    found = [find_windows(spark.sparkContext.broadcast(WindowIndex(items, window)))(text) for items in slices(benchmark, id_col, text_col, slice_bytes)]
    if not found:
        return find_windows(spark.sparkContext.broadcast(WindowIndex([], window)))(text)
    if len(found) == 1:
        return found[0]
    return merge_found(found)


@F.pandas_udf(FOUND)
def _merged(found: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for r in found.itertuples(index=False):
        spans: list[list[int]] = []
        for a, b in sorted([int(x) for x in s] for part in r for s in part["spans"]):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        rows.append((r[0]["n_words"], spans, sorted({i for part in r for i in part["items"]})))
    return pd.DataFrame(rows, columns=["n_words", "spans", "items"])


def merge_found(found: list[Column]) -> Column:
    return _merged(F.struct(*[f.alias(f"s{i}") for i, f in enumerate(found)]))


def cut_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """``text`` without the words of ``spans`` and what stands between them."""
    if text is None or len(spans) == 0:
        return text
    data = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(data.translate(_FOLD), dtype=np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8))).reshape(-1, 2)
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at : edges[a, 0]])
        at = int(edges[b - 1, 1])
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


@F.pandas_udf(T.StringType())
def cleaned_text(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut_spans(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items, spans, contaminated. See ``contamination`` for odd input."""
    found = docs.select(F.col(id_col).alias("doc_id"), contamination(F.col(text_col), benchmark, window, slice_bytes=slice_bytes).alias("found"))
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    found = found.select("doc_id", "found.n_words", hit.alias("n_hit"), "found.items", "found.spans")
    return found.select("*", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", drop: bool = True, window: int = WINDOW) -> DataFrame:
    """``docs`` with the same columns: without contaminated rows, or (``drop=False``) with the hit stretches cut out of their texts."""
    found = contamination(F.col(text_col), benchmark, window)
    if drop:
        return docs.where(F.size(found["spans"]) == 0)
    return docs.withColumn(text_col, cleaned_text(F.col(text_col), found["spans"]))

