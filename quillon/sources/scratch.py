"""Intermediate tables in the folder that all executors share; they go with the application, or earlier by clean_up()."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, str] = {}


def _at(spark: SparkSession, folder: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folder(spark: SparkSession) -> str:
    """This application's own folder in spark.checkpoint.dir; where none is set a local one in local mode (tests), an error on a cluster. The driver deletes it when it ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        _FOLDERS[app] = f"{base.rstrip('/')}/work-{app}"
        store, where = _at(spark, _FOLDERS[app])
        store.mkdirs(where)
        store.deleteOnExit(where)
    return _FOLDERS[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{folder(spark)}/{name}-{uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path, if it is there."""
    store, where = _at(spark, path)
    store.delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application now; what was not yet written from them is lost."""
    delete(spark, folder(spark))


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df, worked out once and reread."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def with_handle(df: DataFrame, handle: str) -> DataFrame:
    """df with a number of its own for every row, written once so that the numbers stand."""
    return stored(df.withColumn(handle, F.monotonically_increasing_id()), "rows")
