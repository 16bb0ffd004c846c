"""The matchup summary kept up to date from the stream of games.

The summary's parts are counts and sums, so a batch of games is merged by adding its parts to those before. Each batch
writes the parts of all games so far as a version of its own, named by the batch. A version counts once its write is
committed (its _SUCCESS file is there). A batch that is run again finds its version and does nothing; one that was broken
off is merged again from the version before. So each game counts once, however often a batch is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.games import MEASURED, game_metrics, measured
from ..operators.summary import added, finished, matchup_parts
from ..sources.logs import with_dimensions
from ..sources.schema import DIMENSIONS
from ..sources.shared import children, deleted, exists
from .games import stream_events


def versions(spark: SparkSession, table: str) -> list[int]:
    """The committed versions, oldest first."""
    found = [x for x in children(spark, table) if x.startswith("batch=")]
    return sorted(int(x.removeprefix("batch=")) for x in found if exists(spark, f"{table}/{x}/_SUCCESS"))


def _parts(spark: SparkSession, table: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{table}/batch={version}")


def merge(events: DataFrame, batch: int, table: str) -> bool:
    """Adds the games of a batch of events to the table, unless that has been done; whether it was done now. Batches come in order.

    Events are read once: what metrics need of them is written beside the table until the batch is merged. Events without
    dimensions have those that their columns matchup and config name.
    """
    spark = events.sparkSession
    known = versions(spark, table)
    if known and known[-1] >= batch:
        return False
    named = [c for c in DIMENSIONS if c in events.columns] or ["matchup", "config"]
    rows = measured(events, named)
    rows.write.mode("overwrite").parquet(f"{table}/_events={batch}")
    parts = matchup_parts(game_metrics(spark.read.schema(rows.schema).parquet(f"{table}/_events={batch}"), dimensions=named), named)
    if named != DIMENSIONS:  # folders of different names may have the same dimensions
        parts = added(with_dimensions(parts).drop(*named))
    if known:
        parts = added(_parts(spark, table, known[-1]).unionByName(parts))
    parts.write.mode("overwrite").parquet(f"{table}/batch={batch}")
    deleted(spark, f"{table}/_events={batch}")
    for old in known[:-1]:  # the last one stays, as what a reader may still have open
        deleted(spark, f"{table}/batch={old}")
    return True


def current(spark: SparkSession, table: str, ranks: bool = True) -> DataFrame:
    """The matchup summary of all games merged so far."""
    known = versions(spark, table)
    if not known:
        raise FileNotFoundError(f"no committed version in {table}")
    return finished(_parts(spark, table, known[-1]), ranks)


def summarise_available(spark: SparkSession, root: str, table: str, checkpoint: str, max_files: int = 1000, lines: bool = False, pattern: str | None = None) -> StreamingQuery:
    """Merges all games not yet merged, max_files files a batch, then ends. Table and checkpoint belong together."""
    events = stream_events(spark, root, max_files, lines, pattern, MEASURED).drop(*DIMENSIONS)
    writer = events.writeStream.foreachBatch(lambda batch, n: merge(batch, n, table) and None).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
