"""A long lineage is cut by writing the rows once to the shared checkpoint folder.

Iterative jobs (components, greedy plans, linkage) call ``cut`` once a round. A
written table is computed once, survives lost executors and gives the next
round file sizes to plan with. Its shuffle files go as soon as it is written. All tables of an application lie in one run folder, which ``clean`` removes when
its results have been read.
"""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="rankloom-ckpt-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session names; in local mode without one, a folder of our own that goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_root()


@lru_cache(maxsize=None)
def _run_name(application: str) -> str:
    return f"rankloom-{application}-{uuid.uuid4().hex[:8]}"


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables and files."""
    return f"{checkpoint_root(spark)}/{_run_name(spark.sparkContext.applicationId)}"


def clean(spark: SparkSession) -> None:
    """Remove the run folder. Call it when no DataFrame that was built from ``cut`` tables is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Whether the shuffle files of an execution are removed at its end; else they stay until the driver happens to collect its garbage.
_TIDY_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_TIDY_SETTING, None)
    spark.conf.set(_TIDY_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY_SETTING)
        else:
            spark.conf.set(_TIDY_SETTING, before)


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.cut_path = path
    return stored


def drop(*stored: DataFrame) -> None:
    """Remove tables that ``cut`` returned. Call it when nothing that is still to run was built from them."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
