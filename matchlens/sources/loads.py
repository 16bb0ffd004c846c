"""Loading log files into the event table, each once, however often a run is broken off.

A load lists the files, takes those that no committed load has, and writes their events to a folder of its own,
<table>/events/load=<name>. Only when that is complete, one small file is added to <table>/_manifest: the load's name with
the files in it. Readers take the events of the loads in the manifest. So a run that ends before its manifest file is
there has done nothing: its folder is never read, its files are loaded by the next run, and cleaned() deletes the folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from . import logs
from .schema import STORED
from .shared import children, deleted, exists

MANIFEST = T.StructType([T.StructField(k, v) for k, v in {"load": T.StringType(), "source_file": T.StringType(), "length": T.LongType(), "modified": T.TimestampType()}.items()])
FORMATS = ("json", "parquet", "csv")


def listed(spark: SparkSession, root: str, pattern: str = "game_*.json") -> DataFrame:
    """source_file, address, length, modified, matchup, config, file_index of each file below root in a folder Timer_...

    Contents aren't read. file_index is the number in game_<n>, -1 without one: files in natural order.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = files.select(logs.decoded(F.col("_metadata.file_path")).alias("source_file"), F.col("path").alias("address"), "length", F.col("modificationTime").alias("modified"))
    matchup, config = logs.folder_names(F.col("source_file"))
    files = files.withColumns({"matchup": matchup, "config": config, "file_index": S.file_index(F.element_at(F.split("source_file", "/"), -1))})
    return files.where(F.col("config").startswith("Timer_"))


def preferred_files(files: DataFrame) -> DataFrame:
    """Of (matchup, config, path) the one path of each configuration: Parquet before CSV, then by name."""
    order = Window.partitionBy("matchup", "config").orderBy(F.when(F.col("path").endswith(".parquet"), 0).otherwise(1), "path")
    return files.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def discovered(spark: SparkSession, root: str, input_format: str = "csv") -> DataFrame:
    """The event files below <root>/<A>_vs_<B>/<configuration>/ of a format: csv, parquet, or auto.

    auto takes a configuration's Parquet files, and its CSV files only if it has none. Columns are those of listed, and format.
    """
    if input_format not in ("csv", "parquet", "auto"):
        raise ValueError(f"unknown format {input_format!r}")
    files = listed(spark, root, "*.{csv,parquet}").withColumn("format", F.element_at(F.split("source_file", r"\."), -1))
    if input_format != "auto":
        return files.where(F.col("format") == input_format)
    has = files.where("format = 'parquet'").select("matchup", "config").distinct().withColumn("has", F.lit(True))
    return files.join(has, ["matchup", "config"], "left").where(F.col("has").isNull() | (F.col("format") == "parquet")).drop("has")


def read_discovered(spark: SparkSession, root: str, input_format: str = "csv") -> DataFrame:
    """The events of the files that discovered gives, both formats in one table. The names of files, not events, go through the driver."""
    found: dict[str, list[str]] = {"parquet": [], "csv": []}
    for r in discovered(spark, root, input_format).select("format", "address").toLocalIterator():
        found[r.format].append(r.address)
    parts = [logs.read_events(spark, paths, fmt, layout="folders") for fmt, paths in found.items() if paths]
    if not parts:
        raise FileNotFoundError(f"no event files of format {input_format} below {root}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def pending(inputs: DataFrame, done: DataFrame, key: str = "source_file") -> DataFrame:
    """Inputs that no earlier run has written."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def manifest(spark: SparkSession, table: str) -> DataFrame:
    """load, source_file, length, modified of all files in committed loads."""
    reader = spark.read.schema(MANIFEST)
    return reader.parquet(f"{table}/_manifest") if exists(spark, f"{table}/_manifest") else spark.createDataFrame([], MANIFEST)


def staged(spark: SparkSession, root: str, table: str, max_files: int = 100_000, lines: bool = False, pattern: str | None = None, arranged: bool = False) -> tuple[str, DataFrame] | None:
    """Writes the events of the next files not yet loaded, in natural order; gives the load's name and its files, or None if none are left.

    Nothing counts before commit(). `arranged` is that of write_events.
    """
    files = pending(listed(spark, root, pattern or (logs.LINES if lines else "game_*.json")), manifest(spark, table))
    taken = files.orderBy("matchup", "config", "file_index", "source_file").limit(max_files).cache()
    try:
        addresses = [r.address for r in taken.select("address").collect()]  # at most max_files
        if not addresses:
            return None
        load = uuid.uuid4().hex
        rows = taken.select(F.lit(load).alias("load"), "source_file", "length", "modified").collect()
    finally:
        taken.unpersist()
    events = logs.flatten_games(logs.read_games(spark, addresses, lines, pattern))
    logs.write_events(events, f"{table}/events/load={load}", arranged=arranged)
    return load, spark.createDataFrame(rows, MANIFEST)


def commit(table: str, files: DataFrame) -> None:
    """Makes a staged load count: its files are added to the manifest as one new file, there at once or not at all."""
    files.coalesce(1).write.mode("append").parquet(f"{table}/_manifest")


def load(spark: SparkSession, root: str, table: str, max_files: int = 100_000, lines: bool = False, pattern: str | None = None, arranged: bool = False) -> int:
    """Loads all files not yet loaded, max_files at a time; how many loads that took."""
    n = 0
    while (one := staged(spark, root, table, max_files, lines, pattern, arranged)) is not None:
        commit(table, one[1])
        n += 1
    return n


def committed(spark: SparkSession, table: str) -> list[str]:
    """The names of the loads in the manifest, one a run."""
    return sorted(r.load for r in manifest(spark, table).select("load").distinct().collect())


def loaded_events(spark: SparkSession, table: str) -> DataFrame:
    """The events of committed loads, with dimensions. Folders of other loads aren't listed among the inputs."""
    loads = committed(spark, table)
    if not loads:
        return logs.with_dimensions(spark.createDataFrame([], STORED))
    return logs.read_events(spark, [f"{table}/events/load={x}" for x in loads if exists(spark, f"{table}/events/load={x}")], "parquet", base=f"{table}/events").drop("load")


def cleaned(spark: SparkSession, table: str) -> int:
    """Deletes the folders of loads that were never committed; how many. Not while another run is loading."""
    left = {f"load={x}" for x in committed(spark, table)}
    old = [x for x in children(spark, f"{table}/events") if x.startswith("load=") and x not in left]
    for x in old:
        deleted(spark, f"{table}/events/{x}")
    return len(old)
