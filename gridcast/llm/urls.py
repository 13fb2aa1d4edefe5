"""URL filters by a cascade of Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.common import bounded_broadcast
from gridcast.session import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Verdict for a url that no list names.
DEFAULT = "allow"
#: A level of more bits (256 MB) is refused; lists of that size have to be dealt out over several cascades.
MOST_BITS = 1 << 31


@dataclass(frozen=True)
class Level:
    """A Bloom filter: bit (h1 + i * h2) mod size for i below ``hashes``, with h1 mixed anew for each level.

    Without that, two keys that collide on one level would do so on all levels of the same size.
    """

    words: np.ndarray
    size: int
    hashes: int
    salt: int

    def bit(self, h1: np.ndarray, h2: np.ndarray, i: int) -> np.ndarray:
        x = h1 + np.uint64(((self.salt + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return (x + np.uint64(i) * (h2 | np.uint64(1))) % np.uint64(self.size)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), dtype=bool)
        for i in range(self.hashes):
            bit = self.bit(h1, h2, i)
            found &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return found


@dataclass(frozen=True)
class Cascade:
    """Levels in turn hold listed keys and the false positives of the level before.

    For the keys it was built over, the first level that does not hold a key tells exactly whether it is listed.
    """

    levels: tuple[Level, ...]

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), dtype=bool)
        at = np.arange(len(h1))
        for level in self.levels:
            at = at[level.holds(h1[at], h2[at])]
            out[at] = ~out[at]
        return out


def key_hashes(host: Column, path: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key; together they stand for it."""
    return F.xxhash64(F.lit(1), host, path), F.xxhash64(F.lit(2), host, path)


def build_level(keys: DataFrame, count: int, rate: float, salt: int) -> Level:
    """A filter for the ``count`` rows (h1, h2) of ``keys``; bits are set by an aggregation, one row per 64 bits."""
    hashes = max(1, round(-math.log2(rate)))
    size = max(64, math.ceil(count * hashes / math.log(2)))
    if size > MOST_BITS:
        raise ValueError(f"a level of {size} bits is too large to broadcast")
    empty = Level(np.zeros(0, dtype=np.uint64), size, hashes, salt)

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h1, h2 = batch["h1"].to_numpy().view(np.uint64), batch["h2"].to_numpy().view(np.uint64)
            bit = np.concatenate([empty.bit(h1, h2, i) for i in range(hashes)])
            word, place = np.unique(bit >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), dtype=np.uint64)
            np.bitwise_or.at(bits, place, np.uint64(1) << (bit & np.uint64(63)))
            yield pd.DataFrame({"word": word.astype(np.int64), "bits": bits.view(np.int64)})

    words = keys.select("h1", "h2").mapInPandas(set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros((size + 63) // 64, dtype=np.uint64)
    for r in words.toLocalIterator():
        out[r["word"]] = np.uint64(r["bits"] & ((1 << 64) - 1))
    return Level(out, size, hashes, salt)


def holds(spark: SparkSession, level: Level):
    shared = spark.sparkContext.broadcast(level)

    @F.pandas_udf(T.BooleanType())
    def inside(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.holds(h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)))

    return inside


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that is exact for all keys of ``universe`` and ``listed`` (h1, h2: longs; repeats are welcome).

    The first level is as tight as the ratio of listed to other keys asks for, so that as many false positives come
    out as there are listed keys; every later level lets half through. All levels are of the size of the list,
    whatever the size of the universe, which is read once, filtered on the map side and only then made distinct.
    """
    spark = listed.sparkSession
    inside = stage(listed.select("h1", "h2").distinct())
    n = inside.count()
    if not n:
        return Cascade(())
    others = universe.select(F.approx_count_distinct("h1")).first()[0]
    rate = min(0.5, math.sqrt(0.5) * n / max(1, others))
    levels = [build_level(inside, n, rate, 0)]
    passed = universe.select("h1", "h2").where(holds(spark, levels[0])("h1", "h2")).distinct()
    outside = stage(passed.join(bounded_broadcast(inside, n), ["h1", "h2"], "left_anti"))
    count = outside.count()
    held, tested = outside, inside
    while count:
        levels.append(build_level(held, count, 0.5, len(levels)))
        wrong = stage(tested.where(holds(spark, levels[-1])("h1", "h2")))
        held, tested, count = wrong, held, wrong.count()
    return Cascade(tuple(levels))


# --- urls ---------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(host: Column, path: Column, most_labels: int, lengths: list[int]) -> Column:
    """All keys (array<struct<host, path>>) under which a rule could name the url.

    These are the last labels of the host, as many as a rule has at most, with the first characters of the path, as
    many as some rule has.
    """
    labels = F.split(host, r"\.", -1)
    wide = F.least(F.size(labels), F.lit(most_labels))
    tails = F.transform(F.sequence(F.lit(1), wide), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    heads = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.char_length(path)), lambda x: F.substring(path, F.lit(1), x))
    return F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda p: F.struct(t.alias("host"), p.alias("path")))))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's; of several
    the longest wins (host and path together, then host). Its text is the rule's host and path. A url that none fits has a null rule
    and the ``default`` verdict: its keys are on no list. A null url, or one without ``://``, has an empty host and path;
    only a rule with an empty path or host could fit it. Other columns are not read. An empty table gives none.

    The keys under which rules could name the urls are the universe. One cascade is built for the blocked and
    one for the allowed keys; both are broadcast (their size follows the lists) and every key is looked up
    in them, exactly and without a join or shuffle of the pages.
    """
    spark = pages.sparkSession
    most = max((host.count(".") + 1 for host, _, _ in rules), default=1)
    lengths = sorted({len(path) for _, path, _ in rules})
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    keys = rule_keys(F.col("host"), F.col("path"), most, lengths) if rules else F.array().cast("array<struct<host string, path string>>")
    parsed = stage(parsed.select("*", F.transform(keys, lambda k: F.struct(k["host"].alias("host"), k["path"].alias("path"), *named(k))).alias("keys")))
    universe = parsed.select(F.explode("keys").alias("k")).select("k.h1", "k.h2")
    listed = spark.createDataFrame([(h, p, v) for h, p, v in rules], "host string, path string, verdict string")
    h1, h2 = key_hashes(F.col("host"), F.col("path"))
    listed = listed.select(h1.alias("h1"), h2.alias("h2"), "verdict")
    names = sorted({v for _, _, v in rules})
    cascades = [build_cascade(listed.where(F.col("verdict") == v), universe) for v in names]
    found = parsed.select("page_id", "host", "path", "keys", looked_up(spark, cascades)(F.col("keys")["h1"], F.col("keys")["h2"]).alias("lists"))
    fits = F.filter(F.arrays_zip("keys", "lists"), lambda x: x["lists"] > 0)
    sized = F.transform(fits, lambda x: F.struct(
        F.char_length(F.concat(x["keys"]["host"], x["keys"]["path"])).alias("n"), F.char_length(x["keys"]["host"]).alias("m"),
        F.concat(x["keys"]["host"], x["keys"]["path"]).alias("rule"), F.element_at(F.array(*[F.lit(v) for v in names]) if names else F.array(F.lit("")), x["lists"]).alias("verdict"),
    ))
    best = found.select("page_id", "host", "path", F.array_max(sized).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def named(key: Column) -> list[Column]:
    h1, h2 = key_hashes(key["host"], key["path"])
    return [h1.alias("h1"), h2.alias("h2")]


def looked_up(spark: SparkSession, cascades: list[Cascade]):
    """A column function (array of h1, array of h2) -> array of list numbers from 1, 0 for none."""
    shared = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def lists(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for first, second in batches:
            sizes = first.map(len).to_numpy()
            h1 = np.concatenate([np.zeros(0, dtype=np.int64), *first]).astype(np.int64).view(np.uint64)
            h2 = np.concatenate([np.zeros(0, dtype=np.int64), *second]).astype(np.int64).view(np.uint64)
            out = np.zeros(len(h1), dtype=np.int32)
            for i, cascade in enumerate(shared.value, 1):
                out[cascade.listed(h1, h2)] = i
            yield pd.Series(np.split(out, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

    return lists
