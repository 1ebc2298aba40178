"""Tables of a run in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="siftwell-")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster without it is refused,
    since a machine-local folder would lose rows there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _local_folder()


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's tables; removed when the driver's Python ends, if Spark still runs then."""
    folder = f"{shared_root(spark)}/siftwell/{spark.sparkContext.applicationId}"
    _removed_at_exit(spark, folder)
    return folder


@functools.cache
def _removed_at_exit(spark: SparkSession, folder: str) -> None:
    atexit.register(forget, spark, folder)


def forget(spark: SparkSession, folder: str | None = None) -> None:
    """Remove this application's tables from the shared folder; results that read them can't be computed any more."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder or run_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Makes Spark remove a query's shuffle files as soon as it ends, on all executors.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, clean: bool = False, path: str | None = None) -> DataFrame:
    """The rows of ``df``, written as Parquet in the shared folder (or to a path there) and read again.

    It cuts lineage: a lost executor costs no recomputation of what came before, later plans see the true size, and
    nothing is computed twice against a changing file system. ``clean``: shuffle files of the writing go at its end,
    not when the driver happens to collect its garbage; for what isn't computed again from ``df``.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    before = spark.conf.get(_CLEANED, "false")
    if clean:
        spark.conf.set(_CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.set(_CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, folders: list[str]) -> None:
    """Remove tables that nothing reads any more."""
    for folder in folders:
        forget(spark, folder)
