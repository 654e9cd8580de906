"""Where intermediate tables live.

Everything that cuts lineage is written as Parquet under the shared folder named by
``spark.checkpoint.dir``, so a lost executor costs a re-read and never a recompute of the
whole job. Reading the files back also gives Catalyst real sizes, which is what decides
broadcast or shuffle joins downstream: no join in this package forces a broadcast.
Joins inside loops, and of tables that grow with the input, are shuffled (:func:`spread`).
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="headwater-")
    return _LOCAL_DIRS[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/headwater/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write once, read back: the result's plan is a plain Parquet scan."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return write_table(df, new_path(df.sparkSession, name))


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles both sides.

    Columns of numbers and of few texts take a tenth of their memory in Parquet files or less. By file sizes, Spark would send such a
    table whole through the driver, once for each round of a loop.
    """
    return df.hint("merge")


#: Whether Spark drops a query's shuffle files as soon as it has run.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``materialize`` for tables that nothing reads once the context is left: then they are deleted.

    Work of many steps would pile up the shuffle files of all of them, as Spark keeps these until the driver's memory
    is cleaned up. Each table written here is read back from its files, so what led to it may go at once.
    """
    root = new_path(spark, name)
    number = itertools.count()
    before = spark.conf.get(_DROP_SHUFFLES, "false")

    def put(df: DataFrame, part: str) -> DataFrame:
        table = write_table(df, f"{root}/{part}-{next(number)}")
        spark._jvm.System.gc()  # finds the shuffles that no plan refers to any more
        return table

    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield put
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
        remove(spark, root)


def write_counted(df: DataFrame, path: str) -> int:
    """Write ``df`` and return its row count from the same job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return int(seen.get["n"])


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _file_system(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote; one that is not there is no error."""
    where, files = _file_system(spark, path)
    files.delete(where, True)


def together(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """Run independent actions at the same time, so that small ones share the cluster.

    Threads keep the caller's job group, and with it cancellation by a streaming query.
    """
    with ThreadPoolExecutor(len(jobs)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [job.result() for job in started]


@contextmanager
def jit_sized_methods(spark: SparkSession) -> Iterator[None]:
    """Keep generated methods below the size the JVM compiles.

    Parsing is one wide projection. Fused into a single method it passes 8000 bytes of bytecode, which
    HotSpot then interprets for ever; with this limit Spark runs it as separate smaller operators.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)
