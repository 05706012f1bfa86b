"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Stands for the shared folder where the session has none; a local session only.
_LOCAL: list[str] = []
#: Tables and folders that this process has made; they go with it.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may do without: it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="readtrim-"))
    return _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/readtrim-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean_up() -> None:
    """Delete all intermediate tables of this process. Frames that still read one of them can't be used any more."""
    context = SparkContext._active_spark_context
    while _MADE and context is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_exit() -> None:
    try:
        clean_up()
    except (Py4JError, OSError):  # the session is gone already; its folder is the cluster's to clear
        pass


def materialize(df: DataFrame, name: str, **options: int | str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: lost executors cost nothing, nothing runs twice. ``options`` are the writer's."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files can't be split that far (one gzip file, one small row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
