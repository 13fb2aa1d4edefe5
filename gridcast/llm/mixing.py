"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import HASH_BITS, WORD, bounded_broadcast, free_name, hash_cuts, on_files, with_row_key
from gridcast.session import stage

#: Weights of the sources in code-point order, repeating; null is the last source.
WEIGHTS = (3, 1, 2)
#: All targets together, in halves of the size of the corpus: 150 %.
TOTAL_HALVES = 3
#: A target is at most so many times the size of its source.
MOST_REPEATS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (k, source, source_size: a row per source) with the target of each source.

    Sources share the total by weight; what lies above a source's cap is shared again among the
    others until no target is above its cap. That level is found directly: in the order of cap by weight, a
    source is full if all sources could be given its ratio without spending more than the total.
    """
    everywhere = Window.partitionBy()
    place = F.row_number().over(everywhere.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    by_ratio = everywhere.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    staged = sizes.select("*", place.alias("place"), weight.alias("weight"))
    staged = staged.select("*", (F.lit(MOST_REPEATS) * F.col("source_size")).alias("cap"))
    staged = staged.select("*", (F.col("cap") / F.col("weight")).alias("ratio"), F.sum("source_size").over(everywhere).alias("total"), F.sum("weight").over(everywhere).alias("all_weights"))
    below, lighter = F.sum("cap").over(by_ratio), F.col("all_weights") - F.sum("weight").over(by_ratio)
    staged = staged.select("*", (2 * (below * F.col("weight") + F.col("cap") * lighter) <= TOTAL_HALVES * F.col("total") * F.col("weight")).alias("full"))
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everywhere)
    left = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(everywhere)
    share = (F.col("weight") * (TOTAL_HALVES * F.col("total") - 2 * spent)).cast("double") / (2 * left).cast("double")
    return staged.select("k", "source", "source_size", "place", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From rows (k, source, h, size) a row per source: k, source_size, target, full (whole copies of it), cut.

    A row with h below ``cut`` is taken ``full + 1`` times, any other ``full`` times. The thresholds are nested: what
    a smaller target takes, a larger one takes too.
    """
    sizes = rows.groupBy("k").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = targets(sizes, weights)
    full = F.when((F.col("source_size") > 0) & (F.col("target") >= F.col("source_size")), F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_REPEATS))).otherwise(0)
    plan = stage(plan.select("*", full.cast("int").alias("full")))
    wanted = plan.select("k", F.lit(0).alias("no"), (F.col("target") - F.col("full") * F.col("source_size")).alias("budget"))
    cuts = hash_cuts(rows.select("k", "h", "size"), wanted)
    return stage(plan.join(cuts.select("k", "cut"), "k"))


#: Low bits of the order that tell rows of one id and text apart.
PLACE_BITS = 16


def order_hash(doc_id: Column, text: Column, place: Column) -> Column:
    """A row's place in the order, below 2^60: 44 bits from its id and text, so that reruns and SQL agree, and 16 from its place in the files.

    The latter only decide between rows that are alike, of which any may be taken.
    """
    identity = F.concat_ws("|", F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    high = F.conv(F.substring(F.md5(identity), 1, (HASH_BITS - PLACE_BITS) // 4), 16, 10).cast("long")
    return F.shiftleft(high, PLACE_BITS) + F.pmod(F.xxhash64(place["file"], place["row"]), F.lit(1 << PLACE_BITS))


def keyed(docs: DataFrame, place: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, k, h and size of every row of ``docs``; ``place`` is the column of its row key."""
    source = F.col(source_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), source.alias("source"), source_key(source).alias("k"),
        order_hash(F.col(id_col), F.col(text_col), F.col(place)).alias("h"), word_count(F.col(text_col)).alias("size"),
    )


def copies(h: Column, full: Column, cut: Column) -> Column:
    return (full + (h < cut).cast("int")).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    Size is the number of words (runs of characters that are not white space; null: 0). A source's whole
    documents are taken in the order of a hash of id, text and place up to the prefix nearest to its target; above its
    own size, all are taken once and the prefix twice, so nothing is taken more than twice. A null source is
    a source of its own. Rows with the same id, or repeated rows, are taken each on its own, so a source made of copies
    of one row meets its target too. Texts of any length are counted whole; the longest of a source bounds how far it
    can miss its target. Sources without words get 0. An empty table gives none. Columns other than the three
    named are not read. There are few sources: one task orders their names.
    """
    docs = on_files(docs)
    place = free_name(docs, "place")
    rows = stage(keyed(with_row_key(docs, place), place, id_col, text_col, source_col))
    plan = mix_plan(rows, weights)
    plan = bounded_broadcast(plan.select("k", "source_size", "target", "full", "cut"), plan.count())
    taken = copies(F.col("h"), F.col("full"), F.col("cut"))
    return rows.join(plan, "k").select("doc_id", "size", "source_size", "target", taken.alias("copies"), (F.col("size") * taken).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs``, all their columns, whatever their names, each as often as ``mix`` takes it; the same rules for nulls, copies, long texts and empty tables hold."""
    docs = on_files(docs)
    place = free_name(docs, "place")
    rows = with_row_key(docs, place)
    plan = mix_plan(stage(keyed(rows, place, id_col, text_col, source_col)), weights)
    k, full, cut, copy = (free_name(rows, f"mix_{name}") for name in ("k", "full", "cut", "copy"))
    plan = plan.select(F.col("k").alias(k), F.col("full").alias(full), F.col("cut").alias(cut))
    joined = rows.join(bounded_broadcast(plan, plan.count()), source_key(F.col(source_col)) == F.col(k))
    times = copies(order_hash(F.col(id_col), F.col(text_col), F.col(place)), F.col(full), F.col(cut))
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).select(*docs.columns)
