"""Session helpers: test sessions, table access and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siltgrove")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    ship(spark)
    return spark


def session() -> SparkSession:
    """The session of the command line: the one that is running or that the cluster's settings ask for; a local one
    where nothing names a master."""
    spark = SparkSession.builder.appName("siltgrove").getOrCreate()
    ship(spark)
    return spark


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark reads."""
    files, at = _path(spark, path)
    return files.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, in any file system that Spark writes; an old one is replaced."""
    files, at = _path(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The whole of a small text file."""
    return spark.read.text(path, wholetext=True).first().value


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_siltgrove_shipped", False):
        return
    context._siltgrove_shipped = True
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="siltgrove-code-")
    atexit.register(shutil.rmtree, folder, True)  # the driver serves the file while it lives
    archive = Path(folder, "siltgrove.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("siltgrove", f.relative_to(root)))
    context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as there are cores, where a small table came in fewer: for steps
    that compute much per row. A table of many files stays as it is and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; only in local mode (tests on one
    machine), where that may be unset, is a folder of our own chosen."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    held = getattr(spark, "_siltgrove_dir", None)
    if held is None:
        held = os.path.join(tempfile.gettempdir(), f"siltgrove-{os.getpid()}-{uuid.uuid4().hex[:8]}")
        spark._siltgrove_dir = held
    return held


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/siltgrove/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove the tables that this application wrote with written(). For the end of a run: tables that were read from
    there can't be read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet below the shared folder and read back. For tables that several jobs
    read: compressed, column-pruned on reading, and still there after an executor is lost."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
