"""Resharding as a minimum-cost flow."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast.llm.common import HASH_BITS, bounded_broadcast, free_name, hash60, hash_cuts, on_files, with_row_key
from gridcast.session import stage

SHARDS = 24
#: The layout that the corpus is taken from: so many shards by the key of the document.
OLD_SHARDS = 16
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: A row group above capacity / LARGE is placed by itself; there are at most LARGE * shards of them.
LARGE = 16
#: Rows that are numbered together.
NUMBERED = 2048
#: A range of the hash with more than so many times NUMBERED rows is numbered in parts.
CROWDED = 8
#: The last bits of a row's hash come from its place in its files, so that rows equal in id and text can be cut apart.
PLACE_BITS = 20


# --- the flow: shards only, on the driver ---------------------------------------


def min_cost_flow(nodes: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost) of a maximum flow of the least cost.

    Cheapest paths are filled level by level: all paths of one cost at once by a blocking flow. With the few
    distinct path costs of a resharding, this takes a few passes over the edges.
    """
    head: list[list[int]] = [[] for _ in range(nodes)]
    to, room, cost = [], [], []
    for a, b, capacity, price in edges:
        for x, y, r, p in ((a, b, capacity, price), (b, a, 0, -price)):
            head[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(p)
    while True:
        far = [math.inf] * nodes
        far[source], queue, queued = 0, deque([source]), [False] * nodes
        while queue:
            a = queue.popleft()
            queued[a] = False
            for e in head[a]:
                if room[e] and far[a] + cost[e] < far[to[e]]:
                    far[to[e]] = far[a] + cost[e]
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if math.isinf(far[sink]):
            return [room[2 * i + 1] for i in range(len(edges))]
        next_edge, dead, path = [0] * nodes, [False] * nodes, []
        at = source
        on_path = {source}
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                at, path, on_path = source, [], {source}
                continue
            while next_edge[at] < len(head[at]):
                e = head[at][next_edge[at]]
                b = to[e]
                if room[e] and far[at] + cost[e] == far[b] and not dead[b] and b not in on_path:
                    break
                next_edge[at] += 1
            else:
                dead[at] = True
                if at == source:
                    break
                on_path.discard(at)
                at = to[path.pop() ^ 1]
                next_edge[at] += 1
                continue
            path.append(e)
            on_path.add(b)
            at = b


def transfers(old: dict[int, int], capacities: list[int]) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) that fill ``capacities`` from ``old`` and move the fewest bytes.

    Bytes that stay in a shard of the same number cost nothing; others cost 1 each and go through one
    common node, so the network has a few edges per shard and not one per pair of shards.
    """
    if sum(old.values()) != sum(capacities):
        raise ValueError("capacities must add up to the bytes there are")
    names = sorted(old)
    node = {name: i for i, name in enumerate(names)}
    hub, first = len(names), len(names) + 1
    source, sink = first + len(capacities), first + len(capacities) + 1
    edges = [(source, node[n], old[n], 0) for n in names]
    stays = [n for n in names if 0 <= n < len(capacities)]
    edges += [(node[n], first + n, min(old[n], capacities[n]), 0) for n in stays]
    edges += [(node[n], hub, old[n], 1) for n in names]
    edges += [(hub, first + j, c, 0) for j, c in enumerate(capacities)]
    edges += [(first + j, sink, c, 0) for j, c in enumerate(capacities)]
    flow = min_cost_flow(sink + 1, edges, source, sink)
    at = len(names)
    found = [(n, n, flow[at + i]) for i, n in enumerate(stays)]
    at += len(stays)
    out = deque((n, flow[at + i]) for i, n in enumerate(names) if flow[at + i])
    into = deque((j, flow[at + len(names) + j]) for j in range(len(capacities)) if flow[at + len(names) + j])
    while out and into:
        (a, x), (b, y) = out.popleft(), into.popleft()
        found.append((a, b, min(x, y)))
        if x > y:
            out.appendleft((a, x - y))
        elif y > x:
            into.appendleft((b, y - x))
    return [f for f in found if f[2]]


def level_capacities(loads: list[int], free: int) -> list[int]:
    """How to pour ``free`` bytes on ``loads`` so that the sums are as near to equal as can be."""
    order = sorted(range(len(loads)), key=lambda j: (loads[j], j))
    total = free
    for used, j in enumerate(order, 1):
        total += loads[j]
        if used == len(order) or total <= used * loads[order[used]]:
            break
    level, extra = divmod(total, used)
    rest = [0] * len(loads)
    for i, j in enumerate(sorted(order[:used])):
        rest[j] = level + (i < extra) - loads[j]
    return rest


# --- rows -------------------------------------------------------------------------


def measured(docs: DataFrame, id_col: str, text_col: str, old_shard: Column | None, old_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, h and old_shard of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    old = F.pmod(F.crc32(key.cast("binary")), F.lit(old_shards)) if old_shard is None else old_shard
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_measures(text), old.cast("int").alias("old_shard"))
    rows = with_row_key(on_files(rows), "place")
    return rows.select("doc_id", "size", "text_crc32", order_hash(F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("place")).alias("h"), "old_shard")


def text_measures(text: Column) -> tuple[Column, Column]:
    """size and text_crc32 of a text that is not null."""
    return (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")


def order_hash(doc_id: Column, size: Column, text_crc32: Column, place: Column) -> Column:
    """A ``hash60`` of id and text whose last bits are a hash of the row's place (see ``with_row_key``).

    Rows of one id lie apart by their texts, and rows that equal each other in both by their places, so neither crowd on
    one side of a cut. Where a row lies otherwise does not depend on the files.
    """
    own = F.shiftright(hash60(place["file"], place["row"]), HASH_BITS - PLACE_BITS)
    return F.shiftleft(F.shiftright(hash60(F.lit("shard"), doc_id, size, text_crc32), PLACE_BITS), PLACE_BITS) + own


def plan_moves(rows: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame, list[tuple[int, int, int]]]:
    """(cuts, large, moves) for ``rows`` of ``measured``.

    Rows of an old shard lie in the order of their hash; a transfer is a stretch of that order. ``cuts``
    (old_shard, stops: array<struct<cut, shard>>) tells which stretch goes where: one row per old shard. ``large``
    (old_shard, h, size, shard) places every row above capacity / 16 (and what shares its hash and size): the
    largest first, in its old shard if it has room, else in the emptiest. The flow then fills what room is left.
    ``moves`` are all transfers (old, new, bytes), the large ones included.
    """
    spark = rows.sparkSession
    old = {r["old_shard"]: int(r["bytes"]) for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}
    total = sum(old.values())
    bound = total / shards / LARGE
    groups = rows.groupBy("old_shard", "h", "size").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > bound)
    loads, placed, moves = [0] * shards, [], []
    for r in sorted(groups.collect(), key=lambda r: (-r["bytes"], r["old_shard"], r["h"], r["size"])):
        home = r["old_shard"]
        stays = 0 <= home < shards and loads[home] + r["bytes"] <= total / shards
        shard = home if stays else min(range(shards), key=lambda j: (loads[j], j))
        loads[shard] += r["bytes"]
        old[home] -= r["bytes"]
        placed.append((home, r["h"], r["size"], shard))
        moves.append((home, shard, int(r["bytes"])))
    large = spark.createDataFrame(placed, "old_shard int, h long, size long, shard int")
    flow = transfers(old, level_capacities(loads, sum(old.values())))
    moves += flow
    stops: dict[int, list[tuple[int, int]]] = {}
    for a, b, size in sorted(flow, key=lambda f: (f[0], f[1] != f[0], f[1])):
        done = stops[a][-1][0] if a in stops else 0
        stops.setdefault(a, []).append((done + size, b))
    wanted = [(str(a), i, float(end), b) for a, ends in stops.items() for i, (end, b) in enumerate(ends)]
    wanted = spark.createDataFrame(wanted, "k string, no int, budget double, shard int")
    small = rows.join(F.broadcast(large), ["old_shard", "h", "size"], "left_anti").select(F.col("old_shard").cast("string").alias("k"), "h", "size")
    cuts = hash_cuts(small, wanted).join(wanted.select("k", "no", "shard"), ["k", "no"])
    cuts = cuts.groupBy(F.col("k").cast("int").alias("old_shard")).agg(F.sort_array(F.collect_list(F.struct("no", "cut", "shard"))).alias("stops"))
    return stage(cuts), large, moves


def reshard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", old_shard: Column | None = None, old_shards: int = OLD_SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, old_shard, shard, slot.

    Shards get nearly equal bytes (UTF-8 bytes of the text, null: none, plus 8 a row) while the fewest bytes leave the
    old shard, which is ``old_shard`` (an int column; null counts as shard -1) or else the layout of ``old_shards`` shards by
    the checksum of the id. Stretches end at whole rows. A shard differs from the mean by a few small
    rows (below a sixteenth of it); only one row larger than the mean makes a shard larger. Slots number the rows
    of a shard from 0 without a gap. Ids may repeat or be null: rows of one id, even with the same text, are dealt like others,
    and which of several equal rows goes where depends on their places in the files. An empty table gives none. Other
    columns are not read.
    """
    home = F.coalesce(old_shard, F.lit(-1)) if old_shard is not None else None
    rows = stage(measured(docs, id_col, text_col, home, old_shards))
    cuts, large, _ = plan_moves(rows, shards)
    return numbered(placed(rows, cuts, large), rows.count(), shards)


def placed(rows: DataFrame, cuts: DataFrame, large: DataFrame) -> DataFrame:
    """``rows`` with their shard. Both sides that are broadcast hold a few entries per shard."""
    found = rows.join(F.broadcast(cuts), "old_shard", "left").join(F.broadcast(large), ["old_shard", "h", "size"], "left")
    ends = F.filter("stops", lambda s: F.col("h") < s["cut"])
    behind = F.element_at("stops", -1)["shard"]
    small = F.coalesce(F.try_element_at(ends, F.lit(1))["shard"], behind)
    return found.select(*[c for c in rows.columns], F.coalesce(F.col("shard"), small).cast("int").alias("to")).withColumnRenamed("to", "shard")


def numbered(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """``rows`` (with shard and h) with slot: 0, 1, ... in each shard.

    A shard is numbered in about total / shards / 2048 ranges of the hash, each by itself, on top of the counts
    of the ranges before it; no task sorts a whole shard. A range crowded by many equal rows is numbered in parts
    by the last bits of the hash, in which such rows differ.
    """
    bits = max(0, math.ceil(math.log2(max(1, total / shards / NUMBERED))))
    rows = rows.select("*", F.shiftright("h", HASH_BITS - bits).alias("range"))
    sizes = rows.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    crowded = sizes.where(F.col("n") > CROWDED * NUMBERED)
    crowded = stage(crowded.select("shard", "range", F.least(F.ceil(F.log2(F.col("n") / NUMBERED)), F.lit(PLACE_BITS)).cast("int").alias("fine")))
    many, parts = crowded.count(), shards << bits
    if many:
        rows = rows.join(bounded_broadcast(crowded, many), ["shard", "range"], "left")
        last = F.expr(f"shiftright(h & {(1 << PLACE_BITS) - 1}, {PLACE_BITS} - fine)")
        rows = rows.withColumn("part", F.coalesce(last, F.lit(0).cast("long"))).drop("fine")
        sizes = rows.groupBy("shard", "range", "part").agg(F.count(F.lit(1)).alias("n"))
        parts += 2 * total // NUMBERED
    else:
        rows, sizes = rows.withColumn("part", F.lit(0).cast("long")), sizes.withColumn("part", F.lit(0).cast("long"))
    before = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "range", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "range", "part").orderBy("h", "size", "text_crc32"))
    slots = rows.select("*", within.alias("within")).join(bounded_broadcast(starts, parts), ["shard", "range", "part"])
    return slots.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("start") + F.col("within") - 1).cast("long").alias("slot"))


def rewrite_affected(spark: SparkSession, old_folder: str, new_folder: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Reshard a Parquet dataset of folders ``shard=N`` and write only the shards that change.

    A shard whose rows all stay and that gets none keeps its old folder. The others are written below
    ``new_folder``; nothing old is changed, so a failed run is simply run again. Returns one row per new
    shard: shard, path, rewritten. The column ``shard`` is the folder's; other columns are kept as they are.
    """
    docs = spark.read.parquet(old_folder)
    rows = stage(measured(docs, id_col, text_col, F.col("shard"), 1))
    cuts, large, moves = plan_moves(rows, shards)
    kept = {a for a, b, _ in moves if a == b} - {x for a, b, _ in moves if a != b for x in (a, b)}
    data = [c for c in docs.columns if c != "shard"]
    keys = measured_columns(docs, id_col, text_col)
    moved = placed(keys, cuts, large).where(~F.col("shard").isin(sorted(kept) or [-1]))
    moved.select(*[F.col(f"data.{c}").alias(c) for c in data], "shard").write.partitionBy("shard").parquet(new_folder)
    paths = [(j, f"{old_folder if j in kept else new_folder}/shard={j}", j not in kept) for j in range(shards)]
    return spark.createDataFrame(paths, "shard int, path string, rewritten boolean")


def measured_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns that decide a row's shard, next to ``data``, the row itself. ``docs`` are read from files."""
    place = free_name(docs, "place")
    data = F.struct(*[F.col(c) for c in docs.columns if c != "shard"])
    size, crc = text_measures(F.coalesce(F.col(text_col), F.lit("")))
    rows = with_row_key(docs, place).select(data.alias("data"), F.col(id_col).alias("doc_id"), size, crc, F.col(place).alias("place"), F.col("shard").cast("int").alias("old_shard"))
    return rows.select("data", "size", order_hash(F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("place")).alias("h"), "old_shard")
