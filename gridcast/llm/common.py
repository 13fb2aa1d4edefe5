"""What several operators of this subpackage need: tables, row keys, hashes, and cuts of a hash order by size."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from gridcast.session import stage

#: The white space of every contract here: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

HASH_BITS = 60
LEVEL_BITS = 12

#: A side with at most so many narrow rows (tens of bytes each) may be broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch, so that a batch of long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def hash60(*identity: Column) -> Column:
    """The first 60 bits of the md5 of the identity, a long in [0, 2^60). A null part counts as the text ``null``.

    It depends on nothing but the values, so reruns, retried tasks and SQL agree.
    """
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in identity])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def on_files(df: DataFrame) -> DataFrame:
    """``df`` if its rows come straight from files, else the same rows written to the shared folder."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
        return df
    except AnalysisException:
        return stage(df)


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``: struct(file long, row long), the place of a row of an ``on_files`` table in its files.

    Unlike generated ids it is the same in every plan and after a lost executor.
    """
    place = df.metadataColumn("_metadata")
    return df.select("*", F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row")).alias(name))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few; else it is joined by shuffling."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def release(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/gridcast-stage/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


CUTS = T.StructType(
    [T.StructField("k", T.StringType()), T.StructField("no", T.IntegerType()), T.StructField("budget", T.DoubleType()), T.StructField("cut", T.LongType())]
)


def hash_cuts(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where to cut the hash order of each key so that what lies before the cut has a given size.

    ``items`` has k (string, not null), h (a ``hash60``) and size (long, not negative); ``wanted`` has k, no (int)
    and budget (double). Returns k, no, budget, cut: of all prefixes of the key's items in the order of
    h, the one with h < cut has the size nearest to the budget (the shorter one at a tie). Items of
    equal h are not parted. A budget of 0 or less gives 0, one of the whole size or more gives 2^60.

    Nothing is sorted: sizes are summed in 4096 ranges of the hash (map-side first), the range that
    holds the budget is found from running sums over ranges, and only the items of such ranges are
    summed again, in ranges 4096 times finer, until the range holds one item or one hash.
    """
    spark = items.sparkSession
    wanted = stage(wanted.select("k", F.col("no").cast("int").alias("no"), F.col("budget").cast("double").alias("budget")))
    rows = wanted.count()
    open_ = wanted.select("*", F.lit(0).cast("decimal(38,0)").alias("base"), F.lit(0).cast("long").alias("prefix"))
    parts = [spark.createDataFrame([], CUTS)]
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        level = items.select("k", F.shiftright("h", shift + LEVEL_BITS).alias("prefix"), F.shiftright("h", shift).alias("b"), "size")
        if shift < HASH_BITS - LEVEL_BITS:
            level = level.join(bounded_broadcast(open_.select("k", "prefix").distinct(), rows), ["k", "prefix"], "left_semi")
        sums = level.groupBy("k", "prefix", "b").agg(F.sum(F.col("size").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("k", "prefix").orderBy("b")
        sums = sums.select("*", (F.sum("s").over(order) - F.col("s")).cast("decimal(38,0)").alias("before"))
        joined = open_.join(sums, ["k", "prefix"], "left")
        start = (F.col("base") + F.col("before")).cast("decimal(38,0)")
        found = joined.where((start.cast("double") < F.col("budget")) & (F.col("budget") <= (start + F.col("s")).cast("double")))
        found = stage(found.select("k", "no", "budget", start.alias("start"), "b", "s", "n"))
        if shift == HASH_BITS - LEVEL_BITS:
            outside = wanted.join(found, ["k", "no"], "left_anti")
            parts.append(outside.select("k", "no", "budget", F.when(F.col("budget") > 0, F.lit(1 << HASH_BITS)).otherwise(0).cast("long").alias("cut")))
        settled = (F.col("n") == 1) | F.lit(shift == 0)
        takes = (2 * F.col("start").cast("double") + F.col("s").cast("double") < 2 * F.col("budget")).cast("long")
        parts.append(found.where(settled).select("k", "no", "budget", F.shiftleft(F.col("b") + takes, shift).alias("cut")))
        open_ = found.where(~settled).select("k", "no", "budget", F.col("start").alias("base"), F.col("b").alias("prefix"))
        if open_.isEmpty():
            break
    cuts = parts[0]
    for part in parts[1:]:
        cuts = cuts.unionByName(part)
    return stage(cuts)
