"""Session settings and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gridcast", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE, skew joins)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        # in a local session the driver does all the work; the default of 1 GB is for one that only plans it
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A session on one machine without the setting uses its warehouse folder. A cluster has to name a folder. A path of the
    local file system may be a mount that all machines share: it is tried once, and refused where what
    executors write is not there for the others. ``spark.gridcast.sharedMount`` says that it is one, without a try.
    """
    context = spark.sparkContext
    local = context.master.startswith("local")
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not local:
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not local and spark.conf.get("spark.gridcast.sharedMount", "false") != "true":
        scheme = _path(spark, named).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
        if scheme == "file" and not _seen_by_all(spark, named):
            raise RuntimeError(f"{named} is on each machine's own disk; name a shared folder in spark.checkpoint.dir.")
    return named


_TRIED: dict[tuple[str, str], bool] = {}


def _seen_by_all(spark: SparkSession, folder: str) -> bool:
    """Whether rows that the executors write to ``folder`` can all be read back. On machines' own disks the driver finds none of the files, or a part."""
    context = spark.sparkContext
    key = context.applicationId, folder
    if key not in _TRIED:
        name, rows = f"{folder.rstrip('/')}/gridcast-stage/{context.applicationId}/{uuid.uuid4().hex}", 4 * max(1, context.defaultParallelism)
        spark.range(0, rows, 1, rows).write.parquet(name)
        _TRIED[key] = spark.read.schema("id long").parquet(name).count() == rows
        path = _path(spark, name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return _TRIED[key]


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _stage_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gridcast-stage/{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables this application has staged. For the end of a run: results that read them are gone with them."""
    path = _path(spark, _stage_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, name: str) -> bool:
    path = _path(spark, name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/gridcast-stage/" in folder:
            path = _path(spark, folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def intact(df: DataFrame) -> bool:
    """Whether every file of a staged table is still there: ``drop_staged`` or a cleaner of the shared folder may have taken some."""
    spark, files = df.sparkSession, df.inputFiles()
    for folder in {f.rsplit("/", 1)[0] for f in files}:
        if not path_exists(spark, folder):
            return False
        path = _path(spark, folder)
        there = {f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
        if not all(f.rsplit("/", 1)[1] in there for f in files if f.startswith(f"{folder}/")):
            return False
    return bool(files)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and continue from the files.

    Used where one result feeds several later steps. A lost executor then costs a
    file read instead of the whole upstream plan, the optimizer sees a short plan,
    and filters and column pruning still reach the staged files.
    """
    spark = df.sparkSession
    path = f"{_stage_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Repartition by ``columns`` over all cores before a step that multiplies rows.

    Adaptive execution sizes partitions by their input, so a small table about to be
    exploded would otherwise end up in one task.
    """
    spark = df.sparkSession
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wide, *columns)
