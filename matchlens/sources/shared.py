"""A folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new name below the folder that the cluster names in spark.checkpoint.dir.

    Only on one machine (a local master), as in tests, a temporary folder takes its place where none is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="matchlens")
    return f"{named}/matchlens-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The store's client, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = file_system(spark, path)
    return store.exists(place)


def deleted(spark: SparkSession, path: str) -> None:
    store, place = file_system(spark, path)
    store.delete(place, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there isn't one."""
    store, place = file_system(spark, path)
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def written(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends there, and its size is known."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
