"""Session defaults.

On a cluster the session comes from the launcher and is used as it is; the settings below only fill a fresh local one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pluvian", cores: str | int = "*", shuffle_partitions: int | None = None,
                  memory: str = "8g") -> SparkSession:
    """Return the running session, or start a local one (tests and the bench)."""
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    builder = (
        SparkSession.builder.appName(app).master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go with the results
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site lookup per column expression
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate results: the one the cluster names in `spark.checkpoint.dir`.

    Only a `local[...]` master, where driver and executors are one process, may fall back to a scratch folder of this
    machine (tests); any other master without a named folder is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = scratch_or_named(spark.conf.get("spark.checkpoint.dir", None), context.master)
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder


def scratch_or_named(named: str | None, master: str) -> str:
    if named:
        return named
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir names no shared folder, which master {master} needs")
    return tempfile.mkdtemp(prefix="pluvian-ckpt-")


def stored(df: DataFrame) -> DataFrame:
    """Checkpoint an intermediate result in the shared folder and go on from there.

    For results that several later steps read: they are computed once, the plan stays short, and a lost executor only costs
    a re-read.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """Like `stored`, as a compressed Parquet table in the shared folder, so later steps read only the columns they name."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, least: int | None) -> DataFrame:
    """`written`, in no fewer than `least` parts. A table with more keeps them, so that parts grow in number and not in size."""
    table = written(df)
    if least and table.rdd.getNumPartitions() < least:
        table = written(table.repartition(least))
    return table


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that this session wrote."""
    place, fs = _file_system(spark, path)
    fs.delete(place, True)


def publish(spark: SparkSession, aside: str, path: str) -> None:
    """Put a finished folder in the place of `path`."""
    (source, fs), (target, _) = _file_system(spark, aside), _file_system(spark, path)
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{aside} could not be renamed to {path}")


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _file_system(spark, path)
    return fs.exists(place)
