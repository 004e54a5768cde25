"""Session helpers: a local builder for tests and bench, and the shared folder for durable cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Codec of cuts, report bytes and their runs: they repeat themselves a lot, and a third of the disk is worth the time.
COMPRESSION = "zstd"


def local_session(cores: str = "8", app: str = "tillmark", memory: str = "16g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch one only in local mode where it is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tillmark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_workspace(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cut lineage through a table in the shared folder.

    A lost executor then re-reads files instead of recomputing an iteration, later steps prune columns,
    and the optimizer knows the size of what was written.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/cut-{uuid.uuid4().hex[:16]}"
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    """Buckets of :func:`durable_by`: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _tables_of(folder: str) -> str:
    """What the names of the bucketed cuts in a folder begin with."""
    return "cut_" + re.sub(r"\W", "_", folder.rstrip("/").rsplit("/", 1)[-1]).lower() + "_"


def durable_by(df: DataFrame, key: str, folder: str | None = None) -> DataFrame:
    """``durable``, its rows in buckets by ``key``: what joins and groups by that key afterwards needs no shuffle.

    Worth it for rows that a shuffle by the same values has just dealt: each task then holds whole buckets, and the table
    has a file per bucket.
    """
    spark = df.sparkSession
    within = folder or shared_folder(spark)
    name = f"{_tables_of(within)}{uuid.uuid4().hex[:16]}"
    written = df.write.format("parquet").option("compression", COMPRESSION).bucketBy(buckets(spark), key)
    written.option("path", f"{within}/{name}").saveAsTable(name)
    return spark.table(name)


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a workspace this application wrote itself, and the names of its bucketed cuts."""
    for row in spark.sql(f"show tables like '{_tables_of(folder)}*'").collect():
        spark.sql(f"drop table if exists {row.tableName}")
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none when it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in files.listStatus(target)] if files.exists(target) else []


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob; one call of the file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return [entry.getPath().toString() for entry in found or []]


def count_files(spark: SparkSession, folder: str, at_most: int) -> int:
    """Files below a folder, empty ones too; counting stops at ``at_most``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    entries = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True)
    count = 0
    while count < at_most and entries.hasNext():
        entries.next()
        count += 1
    return count


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
