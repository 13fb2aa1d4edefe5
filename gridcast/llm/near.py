"""Near-duplicates by b-bit MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.common import free_name, on_files, release, small_batches, with_row_key
from gridcast.llm.components import components
from gridcast.session import stage

#: Words of a shingle, and the similarity from which documents are linked, in percent.
SHINGLE = 5
PERCENT = 75
#: Minima of a signature, bits kept of each, and minima of a band. At a similarity of 0.75 a pair
#: shares none of the 32 bands with probability (1 - 0.75^4)^32 = 5e-6.
MINIMA = 128
BITS = 4
BAND = 4
#: The estimate may fall so many standard deviations below the threshold before a candidate is dropped unverified.
DEVIATIONS = 5
#: Texts are met with the rows to compare only if such a row has the same residue of its key's hash; at most so many longs are broadcast for that.
RESIDUES = 1 << 22
#: Members verified against one hub at a time.
CHUNK = 64

_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_BLANK = np.array([b == 0x20 or 9 <= b <= 13 for b in range(256)])
_RANDOM = np.random.default_rng(20240601)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_UNSTEP = pow(_STEP, -1, 1 << 64)
_PLACES = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MINIMA = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 18

SKETCH = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("planes", T.ArrayType(T.LongType())),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP, _BLOCK + 1), _powers(_UNSTEP, _BLOCK + 1)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for every word; blocks of words bound the memory of a long text."""
    out, at = [], 0
    while at < len(starts):
        base = starts[at]
        last = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        if last == at + 1 and ends[at] - base > _BLOCK:  # one word longer than a block
            digest = hashlib.blake2b(data[base : ends[at]].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(digest, dtype=np.uint64))
        else:
            part = data[base : ends[last - 1]]
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[part] * _UP[: len(part)])])
            a, b = starts[at:last] - base, ends[at:last] - base
            out.append(_mix((total[b] - total[a]) * _DOWN[a] + (b - a).astype(np.uint64)))
        at = last
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``.

    Words are lower-cased (A-Z only) runs without white space; a text of fewer words than a shingle has one,
    its whole sequence; one without words has none.
    """
    if not text:
        return np.zeros(0, dtype=np.uint64)
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    inside = np.concatenate([[False], ~_BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    hashed = _hash_words(data, edges[::2], edges[1::2])
    n = len(hashed)
    if not n:
        return hashed
    width = min(length, n)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total += hashed[i : n - width + 1 + i] * _PLACES[i]
    return np.unique(_mix(total))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each of the ``MINIMA`` hash functions over the shingles."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[None, at : at + 1024] * _MINIMA[:, None]).min(axis=1), out=least)
    return least


def planes(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed: for each of the ``BITS`` bit places, a bit per minimum in longs of 64.

    A minimum's low product bits are those of the shingle alone, so they are taken after mixing.
    """
    low = _mix(least)
    bits = (low[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(BITS * MINIMA // 64, 64), axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of each band of ``BAND`` whole minima, salted with the number of the band."""
    rows = least.reshape(-1, BAND)
    total = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for i in range(BAND):
        total = _mix(total * _PLACES[8 + i] + rows[:, i])
    return total.view(np.int64)


def sketch(length: int = SHINGLE):
    """A column function: text -> struct(n shingles, digest of the set, packed signature, band hashes)."""

    @F.pandas_udf(SKETCH)
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                found = shingles(text, length)
                if len(found):
                    least = minima(found)
                    rows.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), planes(least), bands(least)))
                else:
                    rows.append((0, None, None, None))
            yield pd.DataFrame(rows, columns=["n", "digest", "planes", "bands"])

    return sketched


def shingle_array(length: int = SHINGLE):
    """A column function: text -> its sorted distinct shingle hashes."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t, length).view(np.int64) for t in texts], dtype=object)

    return found


def matching_minima(x: Column, y: Column) -> Column:
    """How many minima agree in all kept bits, by bit counts over the packed signatures."""
    words = MINIMA // 64
    total = F.lit(0)
    for w in range(words):
        differs = F.lit(0).cast("long")
        for b in range(BITS):
            differs = differs.bitwiseOR(x[b * words + w].bitwiseXOR(y[b * words + w]))
        total = total + F.bit_count(F.bitwise_not(differs))
    return total


def similarity_estimate(matches: Column) -> Column:
    """Jaccard similarity from the share of agreeing minima, corrected for minima that agree by chance in ``BITS`` bits."""
    chance = 2.0**-BITS
    return (matches / F.lit(float(MINIMA)) - F.lit(chance)) / F.lit(1 - chance)


def least_estimate(percent: int) -> float:
    chance = 2.0**-BITS
    share = percent / 100 * (1 - chance) + chance
    return percent / 100 - DEVIATIONS * (share * (1 - share) / MINIMA) ** 0.5 / (1 - chance)


def plausible(percent: int, a: str = "a_", b: str = "b_") -> Column:
    """A pair worth verifying: sizes allow the similarity, and the estimate is not far below it."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & (similarity_estimate(matching_minima(F.col(f"{a}planes"), F.col(f"{b}planes"))) >= least_estimate(percent))


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, own = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            linked = []
            for key, chunk, node, found in zip(batch["a"], batch["chunk"], batch["b"], batch["shingles"], strict=True):
                if node is None:
                    hub, own = (key, chunk), found
                    continue
                assert (key, chunk) == hub
                both = len(np.intersect1d(own, found, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(found) - both):
                    linked.append((key, node))
            yield pd.DataFrame(linked, columns=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity. ``sets`` has node, shingles.

    The members of a hub a are dealt out in chunks of ``CHUNK``; a chunk gets the hub's set once and is
    compared row by row from a sorted stream, so a task holds one set and one batch whatever the number of members.
    """
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"))
    hubs = dealt.select("a", "chunk").distinct().join(sets.withColumnRenamed("node", "a"), "a")
    rows = hubs.select("a", "chunk", F.lit(None).cast("binary").alias("b"), "shingles").unionByName(
        dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "shingles")
    )
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return rows.mapInPandas(_verify(percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: row_key, doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of word shingles have a Jaccard similarity of at least ``percent`` / 100; the component of
    a document is the smallest id it can be reached from over links, itself included (nulls come last), and the
    document with that id is kept. A null or blank text has no shingles, is linked with nothing and
    kept. Rows with the same id are decided by their own texts; those in the same component share the flag. ``row_key`` tells
    rows apart (see ``with_row_key``). Columns other than the two named are not read. An empty table gives none.

    1. One pass makes the digest of the set, its b-bit signature and band hashes. Equal digests are one class; a
       class goes on as one node however many copies it has.
    2. Candidates. Every bucket of a band pairs its members with one hub, never with each other; so rows
       grow with members. Pairs are estimated from the bit signatures, then verified on the whole
       sets, at first one pair per node (the best), then those that still join different components.
    3. Members of a bucket that are in different components after that are compared too, so no link is lost to the choice of
       hubs (``remaining_links``): first by their signatures, in blocks; of those with a plausible partner, the ones that
       cannot be similar to any other component are found by counting shared shingles (``undecided``); the rest
       are compared on their whole sets, in blocks of which only links come out. One rule holds for buckets of every size.

    A text of any length is read whole; a task holds the sets of one Arrow batch or of one block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    place = free_name(docs, "row_key")
    keyed = with_row_key(on_files(docs), place).select(F.col(place).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = keyed.select("row_key", "doc_id", sketch(length)(F.col("text")).alias("s"))
    rows = stage(made.select("row_key", "doc_id", "s.n", "s.digest", "s.planes", "s.bands"))
    first = F.min_by(F.struct("row_key", "n", "planes", "bands"), "row_key")
    nodes = stage(rows.where("n > 0").groupBy("digest").agg(first.alias("f")).select(F.col("digest").alias("node"), "f.row_key", "f.n", "f.planes", "f.bands"))
    small = nodes.select("node", "n", "planes")

    buckets = nodes.select("node", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("band")
    members = stage(buckets.join(shared, "band", "left_semi"))  # buckets of one node are gone
    hubs = members.groupBy("band").agg(F.min("node").alias("hub"))
    star = members.join(hubs, "band").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    candidates = stage(estimated(star, small, percent))
    # Texts are joined once: the sets of all nodes that share a bucket serve every comparison that follows.
    compared = members.select("node").distinct().join(nodes.select("node", "row_key"), "node")
    # Most texts leave before the shuffle while the rows to compare are fewer than the residues; beyond that they meet in it.
    residue = F.pmod(F.xxhash64("row_key"), F.lit(RESIDUES)).alias("residue")
    texts = keyed.select("row_key", "text", residue).join(F.broadcast(compared.select(residue).distinct()), "residue", "left_semi")
    sets = stage(texts.join(compared, "row_key").select("node", shingle_array(length)(F.col("text")).alias("shingles")))
    links = EdgeSet(sets, percent)
    best = candidates.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a")).select("a", "b")
    links.add(best)
    links.add(links.across(candidates.select("a", "b")).join(best, ["a", "b"], "left_anti"))

    links.join_in(remaining_links(links, members, small, percent))
    for done in (members, candidates, sets, nodes):
        release(done)

    labelled = links.labelled(rows.select("row_key", "doc_id", "n", F.col("digest").alias("node")))
    least = labelled.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component"))
    joined = labelled.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select("row_key", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "root").select(
        "row_key", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("root").alias("component_key")
    )


def undecided(links: EdgeSet, members: DataFrame, percent: int, rounds: int = 3) -> DataFrame:
    """The nodes among ``members`` (band, node, n, root) of buckets with several components that could still link two of them.

    A node is left out where its shingles rule it out. To be similar to a node of another component, a node of n shingles
    has to share with it at least percent / (100 + percent) of the sum of both sizes, and so at least as many of its own with other
    components at all. A near-copy with many changes of its own is dropped by that count alone, however many it
    shares buckets with; dropping it takes the reason away from others, so the count is repeated a few times.
    """
    spread = stage(members)
    for _ in range(rounds):
        bands = spread.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("n").alias("small"))
        mixed = spread.join(bands.where("least < most").select("band", "small"), "band")
        partner = F.greatest("small", F.ceil(F.col("n") * percent / 100))
        nodes = stage(mixed.groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.min(partner).alias("partner")))
        # longs stand for nodes where each shingle is a row; two nodes of one long would count each other's shingles, which only keeps more
        of_node = F.xxhash64("node").alias("id")
        single = nodes.join(links.shingle_sets, "node").select(of_node, F.xxhash64("root").alias("root"), F.explode("shingles").alias("shingle"))
        apart = single.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("shingle")
        able = single.join(apart, "shingle", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
        able = able.join(nodes.select("*", of_node), "id").where((100 + percent) * F.col("shared") >= percent * (F.col("n") + F.col("partner")))
        able = stage(able.select("node"))
        left = stage(spread.join(able, "node", "left_semi"))
        settled = able.count() == nodes.count()
        release(spread)
        release(nodes)
        spread = left
        if settled:
            break
        release(able)
    return spread.select("node").distinct()


#: Shingles of the probes whose sets one task holds, blocks whose signatures one task holds, and nodes that one task streams past them.
PROBED = 1_000_000
BLOCKS = 32
STREAMED = 200_000


def remaining_links(links: EdgeSet, members: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components among the buckets ``members`` (band, node). ``small`` has node, n, planes.

    In a bucket, every node outside its largest component is a probe, dealt out in blocks of bounded size. The signatures of all
    nodes of the bucket stream past those of ``BLOCKS`` blocks at a time, which leaves the probes with a plausible partner, and for each block the
    nodes that are plausible partners of one of its probes; never pairs. Of these, what shared shingles do not rule out
    (``undecided``) streams past its blocks with whole sets. That covers all pairs of different components in a bucket, and
    nothing but links comes out, at most one per probe, block and component. Buckets of the same nodes are compared once.
    """
    labelled = stage(links.labelled(members.select("band", "node")))
    each = F.xxhash64("node", F.lit(1))
    per = labelled.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(each).alias("x"))
    bands = per.groupBy("band").agg(
        F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("nodes"), F.sum("s").cast("decimal(38,0)").alias("s"), F.bit_xor("x").alias("x"), F.count(F.lit(1)).alias("roots")
    )
    once = bands.where("roots > 1").groupBy("nodes", "s", "x").agg(F.min_by(F.struct("band", "main"), "band").alias("f")).select("f.band", "f.main", "nodes")
    dealt = stage(labelled.join(once, "band").join(small, "node").withColumn("probe", F.col("root") != F.col("main")).drop("main"))
    chunks = dealt.where("probe").groupBy("band").agg(F.ceil(F.sum("n") / PROBED).cast("int").alias("chunks"))
    dealt = dealt.join(chunks, "band").withColumn("slices", F.ceil(F.col("nodes") / STREAMED).cast("int"))
    row = ["band", "probe", "node", "root", "n", "planes"]
    of_node = F.xxhash64("node")
    chunk = F.pmod(of_node, F.col("chunks")).cast("int")
    probes = dealt.where("probe").select(*row, chunk.alias("chunk"), F.floor(chunk / BLOCKS).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    blocks = F.sequence(F.lit(0), F.ceil(F.col("chunks") / BLOCKS).cast("int") - 1)
    streamed = dealt.withColumn("probe", F.lit(False)).select(*row, F.lit(None).cast("int").alias("chunk"), F.explode(blocks).alias("block"), F.pmod(of_node, F.col("slices")).cast("int").alias("slice"))
    place = ["band", "block", "slice"]
    rows = probes.unionByName(streamed).repartition(*place).sortWithinPartitions(*place, F.col("probe").desc())
    marks = stage(rows.mapInPandas(_plausible_partners(percent), "band long, chunk int, probe boolean, node binary, root binary, n long").distinct())
    able = undecided(links, marks.select("band", "node", "n", "root").distinct(), percent)
    rows = marks.drop("n").join(able, "node", "left_semi").join(links.sets_of(able), "node")
    rows = rows.repartition("band", "chunk").sortWithinPartitions("band", "chunk", F.col("probe").desc())
    return rows.mapInPandas(_stream_past(percent), "a binary, b binary")


def _plausible_partners(percent: int):
    words = MINIMA // 64
    least = least_estimate(percent) - 1e-9

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, probes, index = None, [], None

        def hit_probes(band):
            if index is not None:
                for i in np.flatnonzero(index["hit"]).tolist():
                    chunk, node, root, n, _ = index["probes"][i]
                    yield band, chunk, True, node, root, n

        for batch in batches:
            marked = []
            for band, block, part, probe, chunk, node, root, n, planes_ in zip(*(batch[c] for c in ("band", "block", "slice", "probe", "chunk", "node", "root", "n", "planes")), strict=True):
                if (band, block, part) != at:
                    if at is not None:
                        marked.extend(hit_probes(at[0]))
                    at, probes, index = (band, block, part), [], None
                if probe:
                    probes.append((int(chunk), node, root, n, planes_))
                    continue
                if index is None:
                    probes.sort(key=lambda p: p[3])
                    named = {r: i for i, r in enumerate({p[2] for p in probes})}
                    index = {
                        "probes": probes, "roots": named, "hit": np.zeros(len(probes), dtype=bool), "chunk": np.array([p[0] for p in probes], dtype=np.int64),
                        "n": np.array([p[3] for p in probes], dtype=np.int64), "root": np.array([named[p[2]] for p in probes], dtype=np.int64),
                        "planes": np.array([p[4] for p in probes], dtype=np.int64).reshape(len(probes), BITS * words).T.copy(),
                    }
                sizes = index["n"]
                low, high = np.searchsorted(sizes, -(-percent * n // 100), side="left"), np.searchsorted(sizes, 100 * n // percent, side="right")
                if low >= high:
                    continue
                agree = np.full(high - low, MINIMA, dtype=np.int64)
                for w in range(words):
                    differs = np.zeros(high - low, dtype=np.int64)
                    for b in range(BITS):
                        differs |= index["planes"][b * words + w, low:high] ^ planes_[b * words + w]
                    agree -= np.bitwise_count(differs.view(np.uint64))
                chance = 2.0**-BITS
                good = ((agree / MINIMA - chance) / (1 - chance) >= least) & (index["root"][low:high] != index["roots"].get(root, -1))
                if good.any():
                    index["hit"][low:high] |= good
                    marked.extend((band, c, False, node, root, n) for c in np.unique(index["chunk"][low:high][good]).tolist())
            yield pd.DataFrame(marked, columns=["band", "chunk", "probe", "node", "root", "n"])
        if at is not None:
            yield pd.DataFrame(list(hit_probes(at[0])), columns=["band", "chunk", "probe", "node", "root", "n"])

    return run


def _stream_past(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, names, roots, sets, index, done = None, [], [], [], None, set()
        for batch in batches:
            found = []
            for band, chunk, probe, node, root, own in zip(*(batch[c] for c in ("band", "chunk", "probe", "node", "root", "shingles")), strict=True):
                if (band, chunk) != at:
                    at, names, roots, sets, index, done = (band, chunk), [], [], [], None, set()
                if probe:
                    names.append(node)
                    roots.append(root)
                    sets.append(own)
                    continue
                if not names:  # shared shingles ruled out all probes of the block
                    continue
                if index is None:
                    sizes = np.array([len(s) for s in sets])
                    whole = np.concatenate(sets)
                    order = np.argsort(whole, kind="stable")
                    index = whole[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes
                    sets = []
                keys, owners, sizes = index
                low, high = np.searchsorted(keys, own, side="left"), np.searchsorted(keys, own, side="right")
                counts = high - low
                hits = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                both = np.bincount(owners[hits], minlength=len(sizes))
                for i in np.flatnonzero(100 * both >= percent * (sizes + len(own) - both)).tolist():
                    if roots[i] != root and (i, root) not in done:
                        done.add((i, root))
                        found.append((names[i], node))
            yield pd.DataFrame(found, columns=["a", "b"])

    return run


def estimated(pairs: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are worth verifying, with their estimated similarity."""
    a = small.select(*[F.col(c).alias({"node": "a"}.get(c, f"a_{c}")) for c in small.columns])
    b = small.select(*[F.col(c).alias({"node": "b"}.get(c, f"b_{c}")) for c in small.columns])
    joined = pairs.join(a, "a").join(b, "b").where(plausible(percent))
    return joined.select("a", "b", similarity_estimate(matching_minima(F.col("a_planes"), F.col("b_planes"))).alias("estimate"))


class EdgeSet:
    """Verified links so far, as a forest node -> root."""

    def __init__(self, shingle_sets: DataFrame, percent: int):
        self.shingle_sets, self.percent = shingle_sets, percent
        self.forest: DataFrame | None = None

    def sets(self, pairs: DataFrame) -> DataFrame:
        """The shingle sets of all nodes of ``pairs``."""
        return self.sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """The shingle sets of ``wanted`` (node)."""
        return self.shingle_sets.join(wanted, "node", "left_semi")

    def add(self, pairs: DataFrame) -> None:
        pairs = stage(pairs)
        if not pairs.isEmpty():
            self.join_in(verified(pairs, self.sets(pairs), self.percent))
        release(pairs)

    def join_in(self, found: DataFrame) -> None:
        """Add verified links (a, b)."""
        before = self.forest
        if before is not None:
            found = found.unionByName(before.select(F.col("node").alias("a"), F.col("root").alias("b")))
        self.forest = components(found)

    def labelled(self, df: DataFrame) -> DataFrame:
        """``df`` (with node) with root: the node itself where nothing is linked with it."""
        if self.forest is None:
            return df.select("*", F.col("node").alias("root"))
        return df.join(self.forest, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def across(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components."""
        if self.forest is None:
            return pairs
        a = self.labelled(pairs.withColumnRenamed("a", "node")).select(F.col("node").alias("a"), "b", F.col("root").alias("ra"))
        b = self.labelled(a.withColumnRenamed("b", "node")).select("a", F.col("node").alias("b"), "ra", "root")
        return b.where("ra != root").select("a", "b")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates: of each component the row with the smallest id (null last, then the first row) stays."""
    docs = on_files(docs)
    found = stage(near_duplicates(docs, id_col, text_col, length, percent))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = found.where("component_key IS NOT NULL").groupBy("component_key").agg(F.min_by("row_key", order).alias("first"))
    gone = found.join(first, "component_key").where("row_key != first").select("row_key.file", "row_key.row")
    return without_rows(docs, gone)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``on_files``), with all their columns, but those whose place (file, row) is in ``gone``.

    The places are broadcast as masks of 64 rows each, one bit a row: however many rows go, the others with their texts are
    not shuffled to meet them.
    """
    place = free_name(docs, "row_key")
    masked = free_name(docs, "masked")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("row", F.lit(64)).cast("int"))
    masks = gone.groupBy("file", F.shiftright("row", 6).alias("word")).agg(F.bit_or(bit).alias("mask"))
    masks = masks.select(F.struct("file", "word", "mask").alias(masked))
    file, row, mask = F.col(f"{place}.file"), F.col(f"{place}.row"), F.col(f"{masked}.mask")
    here = (file == F.col(f"{masked}.file")) & (F.shiftright(row, 6) == F.col(f"{masked}.word"))
    kept = mask.isNull() | (F.call_function("shiftright", mask, F.pmod(row, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 0)
    return with_row_key(docs, place).join(F.broadcast(masks), here, "left").where(kept).drop(place, masked)
