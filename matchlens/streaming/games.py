"""Game logs as a stream of files: events go to the event table as new games arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.logs import LINES, flatten_games, game_type, with_layout


def stream_events(spark: SparkSession, root: str, max_files: int = 1000, lines: bool = False, pattern: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Events of the logs in <root>/<matchup>/<config>, file by file as they appear; with `lines` files hold a game a line.

    With `columns` only those event columns are there, and only what they are made of is taken from the documents.
    """
    reader = spark.readStream.schema(game_type(columns)).option("multiLine", not lines).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", pattern or (LINES if lines else "game_*.json"))
    games = reader.json(f"{root}/*/*").withColumn("_path", F.col("_metadata.file_path"))
    return flatten_games(with_layout(games, F.col("_path")).drop("_path"), columns)


def ingest_available(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes all games not yet written, each once, then ends; the checkpoint is the manifest."""
    writer = stream_events(spark, root).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.partitionBy("matchup", "config").trigger(availableNow=True).start()
