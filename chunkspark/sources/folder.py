"""The cluster's shared folder: written tables that cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


@lru_cache
def _own(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="chunkspark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in tests, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/chunkspark-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rpartition("/")[0]))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df_path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(df_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with suppress(Exception):
            if spark.sparkContext._jsc is not None:
                drop(path, spark)
