"""Reading nested game logs and event tables; writing events and summaries.

Logs lie in <root>/<A>_vs_<B>/<configuration>/game_<n>.json, or one game a line in files of any name. An event table lies
in <root>/matchup=<A>_vs_<B>/config=<configuration>/, so that filters on competitors and configurations leave folders out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .schema import DIMENSIONS, EVENTS, GAME, PATHS, STORED, narrowed


def decoded(path: Column) -> Column:
    """A file's path as text; Spark gives it as an address, with blanks and the like as %20."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def folder_names(path: Column) -> tuple[Column, Column]:
    """matchup and configuration of a file in the layout of logs or of event tables."""
    parts = F.split(path, "/")
    plain = lambda name, at: F.regexp_replace(F.element_at(parts, at), f"^{name}=", "")
    return plain("matchup", -3), plain("config", -2)


def with_dimensions(df: DataFrame) -> DataFrame:
    """Adds the seven dimensions that the columns matchup and config name."""
    left, right = S.matchup_sides(F.col("matchup"))
    number, text = (lambda m, k: m[k].try_cast("double").alias(k)), (lambda m, k: m[k].alias(k))
    # The name is taken apart once a row, not for each dimension.
    parts = S.once(S.config_map(F.col("config")), lambda m: F.struct(number(m, "Timer"), number(m, "ActInterval"), text(m, "Round"), text(m, "SkillLeft"), text(m, "SkillRight")))
    out = df.withColumn("_parts", parts).withColumns({"Bot_L": left, "Bot_R": right, **{k: F.col("_parts")[k] for k in DIMENSIONS[2:]}})
    return out.drop("_parts")


def with_layout(df: DataFrame, path: Column) -> DataFrame:
    """Adds source_file, matchup, config and the seven dimensions read from the path."""
    matchup, config = folder_names(F.col("source_file"))
    return with_dimensions(df.withColumn("source_file", decoded(path)).withColumns({"config": config, "matchup": matchup}))


#: Files that hold a game a line.
LINES = "*.{json,json.gz}"


def game_type(columns: Sequence[str] | None = None) -> T.StructType:
    """The type of a game document; of the parts that the named event columns are made of, if any are named."""
    return GAME if columns is None else narrowed(GAME, {p for c in ("Category", *columns) for p in PATHS.get(c, ())})


def read_games(spark: SparkSession, root: str | list[str], lines: bool = False, pattern: str | None = None) -> DataFrame:
    """One row a game document, at any depth below root, in folders named Timer_...

    With `lines` files hold a game a line and may have any name; they are split among tasks however large, unless compressed.
    """
    reader = spark.read.schema(GAME).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", pattern or (LINES if lines else "game_*.json"))
    games = with_layout(reader.json(root).withColumn("_path", F.col("_metadata.file_path")), F.col("_path")).drop("_path")
    return games.where(F.col("config").startswith("Timer_"))


def _snapshot(prefix: str, robot: str, only: Column | None = None) -> list[Column]:
    field = lambda name: F.when(only, F.col(f"{robot}.{name}")) if only is not None else F.col(f"{robot}.{name}")
    there = F.col(robot).isNotNull() if only is None else only & F.col(robot).isNotNull()
    flag = lambda name: F.when(there, S.safe_flag(F.col(f"{robot}.{name}")))
    plain = [("PosX", "Position.X"), ("PosY", "Position.Y"), ("Linv", "LinearVelocity"), ("Angv", "AngularVelocity"), ("Rot", "Rotation")]
    return [field(v).alias(prefix + k) for k, v in plain] + [flag(x).alias(prefix + x) for x in ("IsDashActive", "IsSkillActive", "IsOutFromArena")]


def flatten_games(games: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The event table: one row for each player event that isn't a LastPosition; other columns of games stay behind it.

    With `columns` it has those of the event columns only; games may be of game_type(columns) then.
    """
    rest = [c for c in games.columns if c not in ("Index", "Timestamp", "Winner", "Rounds")]
    own = [F.col(k).alias(v) for k, v in {"Index": "g", "Timestamp": "gt", "Winner": "gw"}.items() if k in games.columns]
    rounds = games.select(*rest, *own, F.posexplode("Rounds").alias("round_pos", "r"))
    return flattened(rounds.select("*", F.posexplode("r.PlayerEvents").alias("event_pos", "e")), rest, columns)


def flattened(rows: DataFrame, rest: list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The event table's columns (or those named) from rows of a game (g, gt, gw), a round (r) and an event (e) with their places; and the rest."""
    events = rows.where("e.Category is null or e.Category <> 'LastPosition'")
    collided = F.coalesce(F.col("e.Category") == "Collision", F.lit(False))
    flag = lambda c: F.when(collided, S.safe_flag(F.col(c)))
    made = [
        (F.coalesce("g", F.lit(-1)) + 1).alias("GameIndex"), S.winner_code(F.col("gw")).alias("GameWinner"), F.col("gt").alias("GameTimestamp"),
        F.col("r.Index").alias("RoundIndex"), S.winner_code(F.col("r.Winner")).alias("RoundWinner"), F.col("r.Timestamp").alias("RoundTimestamp"),
        F.col("e.StartedAt").alias("StartedAt"), F.col("e.UpdatedAt").alias("UpdatedAt"), S.actor_code(F.col("e.Actor")).alias("Actor"), S.target_code(F.col("e.Target")).alias("Target"),
        F.col("e.Category").alias("Category"), F.col("e.State").alias("State"), F.col("e.Data.Name").alias("Name"), F.col("e.Data.Duration").alias("Duration"), S.safe_text(F.col("e.Data.Reason")).alias("Reason"),
        *_snapshot("Bot", "e.Data.Robot"), *_snapshot("EnemyBot", "e.Data.EnemyRobot"), *_snapshot("ColBot", "e.Data.Robot", collided), *_snapshot("ColEnemyBot", "e.Data.EnemyRobot", collided),
        flag("e.Data.IsActor").alias("ColActor"), F.when(collided, F.col("e.Data.Impact")).alias("ColImpact"), flag("e.Data.IsTieBreaker").alias("ColTieBreaker"), F.when(collided, F.col("e.Data.LockDuration")).alias("ColLockDuration"),
    ]
    named = [c for name, c in zip(EVENTS.names, made, strict=True) if columns is None or name in columns]
    return events.select(*named, *rest, "round_pos", "event_pos")


def read_events(spark: SparkSession, path: str | list[str], fmt: str | None = None, lenient: bool = False, layout: str = "table", base: str | None = None) -> DataFrame:
    """Event tables by format: Parquet, or CSV with the fixed schema (lenient: bad cells are null, else an error).

    Layout "table" is what write_events writes: matchup and config are partition columns, a game's file and its events'
    places are stored, and filters on the dimensions leave folders out. `base` is the table's root where paths are folders
    within it. Layout "folders" is a file for each configuration in <root>/<A>_vs_<B>/<configuration>/; there the file is
    the game's.
    """
    fmt = fmt or (path if isinstance(path, str) else path[0]).rstrip("/").rpartition(".")[2]
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported format {fmt!r}")
    if layout not in ("table", "folders"):
        raise ValueError(f"unknown layout {layout!r}")
    reader = spark.read.schema(STORED if layout == "table" else EVENTS)
    if layout == "folders":
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{fmt}")
    elif base:
        reader = reader.option("basePath", base)
    if fmt == "csv":
        reader = reader.options(**CSV).option("mode", "PERMISSIVE" if lenient else "FAILFAST")
    df = reader.format(fmt).load(path)
    if layout == "folders":
        return with_layout(df.withColumn("_path", F.col("_metadata.file_path")), F.col("_path")).drop("_path")
    return with_dimensions(df)


def limit_configs(df: DataFrame, n: int) -> DataFrame:
    """The first n configurations of each matchup, by name."""
    named = df.select("matchup", "config").distinct()
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("matchup").orderBy("config"))).where(F.col("_n") <= n).drop("_n")
    return df.join(first, ["matchup", "config"], "left_semi")


#: Quotes within quotes are doubled; a text of no characters is not a null.
CSV = {"header": True, "escape": '"'}


def write_events(events: DataFrame, path: str, fmt: str = "parquet", ten_digits: bool = False, arranged: bool = False) -> None:
    """Adds to the event table at path, partitioned by matchup and configuration; Parquet with zstd, or CSV with gzip.

    Rows are dealt by configuration, large ones to several tasks, so that a folder gets few files. With `arranged` they are
    written by the tasks that read them: so where they come from few, large files of one configuration each. Stored are the event
    columns, the game's file and the places of round and event in it (null where events don't have them); read_events
    gives the dimensions again. CSV holds numbers in full, or with `ten_digits` as texts of ten significant digits; line
    breaks within a text aren't read back from CSV.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported format {fmt!r}")
    stored = events.select(*[(F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORED])
    if fmt == "csv" and ten_digits:
        stored = stored.withColumns({f.name: S.ten_digits(F.col(f.name)) for f in STORED if f.dataType.simpleString() == "double"})
    writer = (stored if arranged else stored.hint("rebalance", "matchup", "config")).write.partitionBy("matchup", "config").mode("append")
    writer.option("compression", "zstd").parquet(path) if fmt == "parquet" else writer.options(**CSV, compression="gzip", maxRecordsPerFile=1_000_000).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A small summary as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_summary(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def positions(events: DataFrame, actor: int | None = None, keep: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """Six columns (and those to keep) of events with a position; of one actor or all."""
    rows = events.select(*[c for c in keep if c in events.columns], "GameIndex", "UpdatedAt", "Actor", "BotPosX", "BotPosY", "BotRot").dropna(subset=["BotPosX", "BotPosY", "BotRot"])
    return rows if actor is None else rows.where(F.col("Actor") == actor)


def competitor_positions(events: DataFrame, bot: str | None = None, side: str = "both", max_configs: int | None = None) -> DataFrame:
    """Positions with Bot, Opponent and Side (L, R) of one competitor or all; names must be equal, not contained.

    One competitor's positions are read from the folders of its matchups only. With max_configs only the first
    configurations of each matchup count.
    """
    if side not in ("left", "right", "both"):
        raise ValueError(f"unknown side {side!r}")
    left = F.col("Actor") == 0
    if bot is not None:
        as_left, as_right = F.col("Bot_L") == bot, F.col("Bot_R") == bot
        events = events.where(as_left if side == "left" else as_right if side == "right" else as_left | as_right)
    if max_configs is not None:
        events = limit_configs(events, max_configs)
    rows = positions(events, keep=("source_file", "matchup", "config", "Bot_L", "Bot_R", "Timer"))
    rows = rows.withColumns({"Bot": F.when(left, F.col("Bot_L")).otherwise(F.col("Bot_R")), "Opponent": F.when(left, F.col("Bot_R")).otherwise(F.col("Bot_L")), "Side": F.when(left, "L").otherwise("R")})
    rows = rows if side == "both" else rows.where(left if side == "left" else ~left)
    return rows if bot is None else rows.where(F.col("Bot") == bot)


def matchup_positions(events: DataFrame, bot1: str | None = None, bot2: str | None = None, max_configs: int | None = None) -> DataFrame:
    """Positions of both sides, of all matchups or of the one of two competitors, whichever is left."""
    if (bot1 is None) != (bot2 is None):
        raise ValueError("name both competitors or none")
    if bot1 is not None:
        is_ = lambda a, b: (F.col("Bot_L") == a) & (F.col("Bot_R") == b)
        events = events.where(is_(bot1, bot2) | is_(bot2, bot1))
    if max_configs is not None:
        events = limit_configs(events, max_configs)
    return positions(events, keep=("source_file", "matchup", "config", "Bot_L", "Bot_R", "Timer"))


def union_widened(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns in any order, each column in the widest of its types; a column that is text in one is text.

    Frames that lack a column are an error, as are types with no common one.
    """
    frames = list(frames)
    names = frames[0].columns
    if any(sorted(f.columns) != sorted(names) for f in frames):
        raise ValueError("frames have different columns")

    def widest(name: str) -> T.DataType:
        kinds = [f.schema[name].dataType for f in frames if not isinstance(f.schema[name].dataType, T.NullType)] or [T.NullType()]
        order = [T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType]
        if all(k == kinds[0] for k in kinds):
            return kinds[0]
        if any(type(k) not in order for k in kinds) or any(isinstance(k, T.BooleanType) for k in kinds) and not any(isinstance(k, T.StringType) for k in kinds):
            raise ValueError(f"no common type for column {name!r}")
        top = max(kinds, key=lambda k: order.index(type(k)))
        # A float doesn't hold all whole numbers.
        return T.DoubleType() if isinstance(top, T.FloatType) and any(isinstance(k, T.IntegerType | T.LongType) for k in kinds) else top

    types = {n: widest(n) for n in names}
    return reduce(DataFrame.unionByName, [f.select(*[F.col(f"`{n}`").cast(types[n]).alias(n) for n in names]) for f in frames])


def competitors(df: DataFrame) -> DataFrame:
    """The different names on either side."""
    return df.select(F.col("Bot_L").alias("Bot")).union(df.select("Bot_R")).where("Bot is not null").distinct()
