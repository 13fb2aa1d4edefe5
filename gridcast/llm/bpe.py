"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pairs of neighbouring pieces that may be merged wait in one bucket per rank. A bitmap says which buckets hold something, a
second bitmap which words of the first are not zero, and so on up to a single word; the next rank is found by taking the lowest
set bit of a word on each level. A merge changes two neighbours, which are put into the buckets of their new ranks; their old entries stay where
they are and are skipped when their bucket is opened. So a pre-token of n bytes costs about n steps, however long it is. Short ones go
through one queue together, as it makes no difference to them, and a bucket of many positions is merged with array operations.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.common import free_name, small_batches

#: The largest vocabulary file that is sent to the executors.
VOCABULARY_BYTES = 64 << 20
#: Encoded pre-tokens a worker remembers, and the longest that is worth remembering.
REMEMBERED, SHORT = 400_000, 64
#: Bytes of pre-tokens that share a queue.
TOGETHER = 1 << 19
#: Characters of texts that are split at once; a longer text is split alone.
AT_ONCE = 1 << 21
#: Positions from which on a bucket is merged with array operations, how many of them at once, and the longest words of a vocabulary for which that is prepared.
MANY, STEP, LONGEST = 24, 1 << 16, 256

_BITS = 8
_WORD = 1 << _BITS
_LOW = _WORD - 1


class RankQueue:
    """Positions by rank; the lowest rank comes first, and within it the lowest position."""

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        while True:
            ranks = -(-ranks // _WORD)
            self.levels.append([0] * max(1, ranks))
            if ranks <= 1:
                break
        self.top = self.levels[-1]
        self.below = self.levels[-2::-1]
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        for level in self.levels:
            word = rank >> _BITS
            was = level[word]
            level[word] = was | 1 << (rank & _LOW)
            if was:  # the levels above know of this word
                break
            rank = word

    def put_all(self, rank: int, positions: list[int]) -> None:
        self.put(rank, positions[0])
        self.buckets[rank] += positions[1:]

    def least(self) -> int:
        """The lowest rank with a bucket, -1 if there is none: find-first-set on each level."""
        word = self.top[0]
        if not word:
            return -1
        rank = (word & -word).bit_length() - 1
        for level in self.below:
            word = level[rank]
            rank = rank << _BITS | (word & -word).bit_length() - 1
        return rank

    def take(self, rank: int) -> list[int]:
        """Remove the bucket of ``rank``; its positions in order."""
        bucket = self.buckets.pop(rank)
        for level in self.levels:
            word = rank >> _BITS
            level[word] &= ~(1 << (rank & _LOW))
            if level[word]:
                break
            rank = word
        bucket.sort()
        return bucket


class Coder:
    """Encodes pre-tokens by the ranks of a vocabulary (bytes -> rank; every single byte is a word) and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        words = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.words = _array(pa.binary(), len(words), _ends(self.lengths).astype(np.int32), b"".join(words))
        self.queue = RankQueue(len(words))
        self.twos = np.full(1 << 16, -1, dtype=np.int32)
        self.singles = np.full(1 << 8, -1, dtype=np.int32)
        for word, rank in ranks.items():
            if len(word) == 2:
                self.twos[word[0] << 8 | word[1]] = rank
            elif len(word) == 1:
                self.singles[word[0]] = rank
        self.scratch = np.full(len(words), -1, dtype=np.int32)

    @cached_property
    def partners(self) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """For words on the left of a pair, then on the right: where the row of each begins, the words that make a word with it, and the ranks of those.

        Empty for a vocabulary with very long words or with two of one rank.
        """
        if self.lengths.max(initial=0) > LONGEST or len(set(self.ranks.values())) < len(self.ranks):
            return []
        find, lefts, rights, made = self.ranks.get, array("i"), array("i"), array("i")
        for word, rank in self.ranks.items():
            for cut in range(1, len(word)):
                left = find(word[:cut])
                if left is not None and (right := find(word[cut:])) is not None:
                    lefts.append(left)
                    rights.append(right)
                    made.append(rank)
        sides = [np.frombuffer(x, dtype=np.int32) if len(x) else np.zeros(0, dtype=np.int32) for x in (lefts, rights)]
        made = np.array(made, dtype=np.int32)
        out = []
        for own, other in (sides, sides[::-1]):
            order = np.argsort(own, kind="stable")
            out.append((_ends(np.bincount(own, minlength=len(self.lengths))).tolist(), other[order].astype(np.int64), made[order]))
        return out

    def _found(self, side: int, rank: int, others: np.ndarray) -> np.ndarray:
        """The ranks of the words that ``rank`` on this side (0: left) makes with each of ``others``, -1 where there is none."""
        rows, words, made = self.partners[side]
        row = slice(rows[rank], rows[rank + 1])
        if row.start == row.stop:
            return np.full(len(others), -1, dtype=np.int32)
        self.scratch[words[row]] = made[row]
        found = self.scratch[others]
        self.scratch[words[row]] = -1
        return found

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, packed as 32-bit integers.

        Of all neighbours within a pre-token that make a word, those of the lowest rank merge first, from the left. The
        pre-tokens stand one after the other and share one queue; no merge crosses an edge between two.
        """
        find, data = self.ranks.get, b"".join(pieces)
        n = len(data)
        edge = bytearray(n + 1)
        starts = list(accumulate(map(len, pieces), initial=0))
        for i in starts:
            edge[i] = 1
        after, before, paired, token = links = self._linked(data, edge)
        views = [np.frombuffer(edge, dtype=np.uint8), *[np.frombuffer(x, dtype=np.int32) for x in links]] if n else []
        many = MANY if n and self.partners and views[-1].min() >= 0 else n + 1
        queue = self.queue
        buckets, put = queue.buckets, queue.put
        while (rank := queue.least()) >= 0:
            waiting, lower = queue.take(rank), False
            if len(waiting) >= many and all(self._merged(rank, waiting[k : k + STEP], *views) for k in range(0, len(waiting), STEP)):
                continue
            for done, i in enumerate(waiting, 1):
                if paired[i] != rank:
                    continue  # stale
                gone = after[i]
                end = after[i] = after[gone]
                paired[gone] = token[gone] = -1
                token[i] = rank
                if edge[end]:
                    paired[i] = -1
                else:
                    before[end] = i
                    found = paired[i] = find(data[i : after[end]], -1)
                    if found >= 0:
                        lower |= found < rank
                        bucket = buckets.get(found)
                        if bucket is None:
                            put(found, i)
                        else:
                            bucket.append(i)
                if not edge[i]:
                    left = before[i]
                    found = paired[left] = find(data[left:end], -1)
                    if found >= 0:
                        lower |= found < rank
                        bucket = buckets.get(found)
                        if bucket is None:
                            put(found, left)
                        else:
                            bucket.append(left)
                if lower:  # a vocabulary whose longer words may rank before their parts
                    for rest in waiting[done:]:
                        if paired[rest] == rank:
                            put(rank, rest)
                    break
        token = np.array(token, dtype=np.int32)
        alive = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(token >= 0)])[starts] * 4
        packed, bounds = token[token >= 0].tobytes(), alive.tolist()
        return [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _merged(self, rank: int, waiting: list[int], edge: np.ndarray, after: np.ndarray, before: np.ndarray, paired: np.ndarray, token: np.ndarray) -> bool:
        """Merge these positions of a bucket at once; False, and nothing changed, if a pair of a lower rank would come up on the way."""
        i = np.array(waiting, dtype=np.int64)
        i = i[paired[i] == rank]
        if not len(i):
            return True
        gone = after[i]
        touching = gone[:-1] == i[1:]
        if touching.any():  # of a run such as aaaa every second, from the left
            places = np.arange(len(i))
            firsts = np.maximum.accumulate(np.where(np.concatenate([[False], touching]), 0, places))
            kept = (places - firsts) % 2 == 0
            i, gone = i[kept], gone[kept]
        end = after[gone]
        right = edge[end] == 0
        heads, ends = i[right], end[right]
        # A merged neighbour on the left counts, one on the right does not, as it is merged later: its pair with this one is its left pair.
        left = before[i]
        next_to = np.flatnonzero(end[:-1] == i[1:])
        left[next_to + 1] = i[next_to]
        lefts = token[left]
        lefts[next_to + 1] = rank
        inner = edge[i] == 0
        left, lefts = left[inner], lefts[inner]
        found = np.concatenate([self._found(0, rank, token[ends]), self._found(1, rank, lefts)])
        places = np.concatenate([heads, left])
        some = np.flatnonzero(found >= 0)
        ranks = found[some]
        if len(some) and ranks.min() < rank:
            return False
        after[i] = end
        before[ends] = heads
        token[i] = rank
        token[gone] = paired[gone] = paired[i] = -1
        paired[heads] = found[: len(heads)]
        paired[left] = found[len(heads) :]
        if len(some):
            self._put(ranks, places[some])
        return True

    def _put(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Put the ``places`` into the buckets of their ``ranks``."""
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order].tolist()
        firsts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(places)]
        for rank, a, b in zip(ranks[firsts[:-1]].tolist(), firsts, firsts[1:], strict=False):
            self.queue.put_all(rank, places[a:b])

    def _linked(self, data: bytes, edge: bytearray) -> tuple[array, array, array, array]:
        """The list of single bytes: after, before, the rank under which each waits (-1: none) and its id (-1: merged away); fills the queue."""
        n = len(data)
        flat = np.frombuffer(data, dtype=np.uint8).astype(np.int32)
        ranks = np.full(n, -1, dtype=np.int32)
        ranks[:-1] = np.where(np.frombuffer(edge, dtype=np.uint8)[1:n], -1, self.twos[flat[:-1] << 8 | flat[1:]]) if n > 1 else ranks[:-1]
        places = np.flatnonzero(ranks >= 0)
        if len(places):
            self._put(ranks[places], places)
        steps = np.arange(-1, n + 1, dtype=np.int32)
        return tuple(array("i", numbers.tobytes()) for numbers in (steps[2:], steps[:-2], ranks, self.singles[flat]))

    def decode(self, ids: np.ndarray) -> tuple[pa.Buffer | bytes, np.ndarray]:
        """(bytes of all ids one after the other, where each begins and the last ends)."""
        ends = _ends(self.lengths[ids])
        if not len(ids):
            return b"", ends
        return self.words.take(_array(pa.int32(), len(ids), ids.astype(np.int32, copy=False))).buffers()[2], ends


def _ends(sizes: np.ndarray) -> np.ndarray:
    """Where each of parts of these sizes, one after the other, begins, and where the last ends."""
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(sizes, dtype=np.int64)])


def _array(kind: pa.DataType, n: int, *buffers) -> pa.Array:
    """An array without nulls on ``buffers`` as they are. ``pa.array`` would load pandas, 40 MB in every worker."""
    return pa.Array.from_buffers(kind, n, [None, *map(pa.py_buffer, buffers)])


def _numbers(column: pa.Array, kind: type = np.int32) -> np.ndarray:
    """The numbers of a column without nulls, where they are."""
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column)] if len(column) else np.zeros(0, dtype=kind)


class _Known(dict):
    """Numbers by pre-token, and the ids of each number. Above ``REMEMBERED`` only the most used half stays, so the size is bounded."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder
        self.fresh: list[str] = []
        self.ids = np.zeros(0, dtype=np.int32)
        self.begins, self.sizes, self.uses = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.begins) + len(self.fresh)
        self.fresh.append(word)
        return number

    def learn(self, words: Iterable[str]) -> None:
        """Encode the ``words``, which have numbers but no ids yet, about ``TOGETHER`` bytes at a time, in one queue each."""
        ranks, whole, names, pieces, size = self.coder.ranks, {}, [], [], 0
        parts: list[tuple[list[int], list[bytes]]] = []
        for word in words:
            piece = word.encode("utf-8", "surrogatepass")
            rank = ranks.get(piece)
            if rank is not None:
                whole[self[word]] = array("i", [rank]).tobytes()
                continue
            names.append(self[word])
            pieces.append(piece)
            size += len(piece)
            if size >= TOGETHER:
                parts.append((names, self.coder.encode(pieces)))
                names, pieces, size = [], [], 0
        parts += [(names, self.coder.encode(pieces)), (list(whole), list(whole.values()))]
        numbers = np.array(list(chain.from_iterable(names for names, _ in parts)), dtype=np.int64)
        packed = list(chain.from_iterable(found for _, found in parts))
        ends = len(self.ids) + _ends(np.array([len(ids) // 4 for ids in packed], dtype=np.int64))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(packed), dtype=np.int32)])
        more = np.zeros(len(numbers), dtype=np.int64)
        self.begins, self.sizes, self.uses = (np.concatenate([x, more]) for x in (self.begins, self.sizes, self.uses))
        self.begins[numbers], self.sizes[numbers] = ends[:-1], np.diff(ends)

    def packed(self, pieces: list[list[str]]) -> list[bytes]:
        """For each text its pre-tokens' ids, one after the other."""
        if max(len(self.begins), len(self.ids) // 16) > REMEMBERED:
            self._forget()
        counts = [len(found) for found in pieces]
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(pieces)), dtype=np.int64, count=sum(counts))
        fresh, self.fresh = self.fresh, []
        if fresh:
            self.learn(fresh)
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        flat, ends = self._taken(numbers)
        packed, bounds = flat.tobytes(), (ends[_ends(np.array(counts, dtype=np.int64))] * 4).tolist()
        for word in fresh:
            if len(word) > SHORT:
                del self[word]
        return [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _taken(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of these numbers, one after the other, where those of each begin and the last end)."""
        sizes = self.sizes[numbers]
        ends = _ends(sizes)
        return self.ids[np.repeat(self.begins[numbers] - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def _forget(self) -> None:
        """Keep the most used half, of equally used ones the later; uses count half from now on."""
        words, numbers = list(self), np.fromiter(self.values(), dtype=np.int64, count=len(self))
        kept = np.sort(np.argsort(self.uses[numbers], kind="stable")[-max(1, REMEMBERED // 2) :])
        numbers = numbers[kept]
        self.ids, ends = self._taken(numbers)
        self.begins, self.sizes, self.uses = ends[:-1], np.diff(ends), self.uses[numbers] // 2
        self.clear()
        self.update((words[k], number) for number, k in enumerate(kept.tolist()))


def read_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Lines of a word in base64 and its rank."""
    return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}


@lru_cache(maxsize=2)
def _coder(vocabulary: bytes) -> Coder:
    return Coder(read_ranks(vocabulary))


@lru_cache(maxsize=4)
def encoder(vocabulary: bytes, pattern: str) -> Callable[[list[str | None]], list[bytes]]:
    """texts -> packed ids: every match of ``pattern`` is encoded on its own; what no match covers is left out, as by the usual libraries."""
    import regex

    found, known = regex.compile(pattern), _Known(_coder(vocabulary))
    split = (lambda t: [m.group() for m in found.finditer(t)]) if found.groups else found.findall

    def encoded(texts: list[str | None]) -> list[bytes]:
        out, part, size = [], [], 0
        for text in texts:
            part.append(split(text) if text else [])
            size += len(text or "")
            if size >= AT_ONCE:
                out += known.packed(part)
                part, size = [], 0
        return out + known.packed(part)

    return encoded


def load_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read once here and broadcast. Its size is checked; it does not grow with the data."""
    with open(path, "rb") as file:
        vocabulary = file.read(VOCABULARY_BYTES + 1)
    if len(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>, or a free name like it) added: the ids of the whole text; null and empty texts have none.

    Rows are taken one by one and in place, so repeated rows, repeated or null ids and other columns, whatever their names, stay as they are,
    and an empty table gives an empty one. A very long text, also one of a single pre-token, costs time and memory in
    proportion to its length. ``vocabulary`` is the path of a file of base64 words and ranks that the driver can read, ``pattern`` the
    expression whose matches are encoded each on its own. No text is a special token.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared, name = load_vocabulary(spark, vocabulary), free_name(docs, ids_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(shared.value, pattern)
        for batch in batches:
            packed = encoded(batch.column(at).to_pylist())
            ends = _ends([len(ids) // 4 for ids in packed])
            values = _array(pa.int32(), int(ends[-1]), b"".join(packed))
            made = pa.ListArray.from_arrays(_array(pa.int32(), len(ends), ends.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decoded(spark: SparkSession, ids: Column, vocabulary: str) -> Column:
    """The bytes that ``ids`` stand for, as a binary column; null where ``ids`` is null. Bytes, since an id may end inside a character."""
    shared = load_vocabulary(spark, vocabulary)

    @F.arrow_udf(T.BinaryType())
    def joined(column: pa.Array) -> pa.Array:
        flat, sizes = _numbers(column.flatten()), _numbers(column.value_lengths().fill_null(0))
        data, ends = _coder(shared.value).decode(flat)
        places = ends[_ends(sizes)]
        nulls = _numbers(column.is_valid().cast(pa.uint8()), np.uint8)
        valid = pa.py_buffer(np.packbits(nulls, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(column), [valid, pa.py_buffer(places.astype(np.int32).tobytes()), pa.py_buffer(data)])

    return joined(ids)
