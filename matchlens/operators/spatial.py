"""Positions in the arena: phases, windows of time, distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .spans import with_group

# The arena's centre and radius, a tile's side, the windows of time in seconds.
CENTER_X, CENTER_Y, RADIUS, TILE = 0.24, 1.97, 4.73485, 0.7
WINDOWS = ((0, 15), (15, 30), (30, 45), (45, 60))
GAME = ("source_file", "GameIndex")


def skip_initial(df: DataFrame, seconds: float, keys: Sequence[str] = GAME, t: str = "UpdatedAt") -> DataFrame:
    """Without what lies less than so many seconds after a game's first row."""
    return with_group(df, keys, F.min(t).alias("_first")).where(F.col(t) >= F.col("_first") + seconds).drop("_first")


def with_phase(df: DataFrame, n: int = 3, keys: Sequence[str] = GAME, t: str = "UpdatedAt") -> DataFrame:
    """Adds phase, 0 to n - 1: equal parts of a game's time, closed on the left, the last on both sides."""
    rows = with_group(df, keys, F.min(t).alias("_low"), F.max(t).alias("_high"))
    share = F.try_divide((F.col(t) - F.col("_low")) * n, F.col("_high") - F.col("_low"))
    return rows.withColumn("phase", F.when(share.isNull(), 0).otherwise(F.least(F.floor(share), F.lit(n - 1))).cast("int")).drop("_low", "_high")


def with_time_window(df: DataFrame, skip: float = 0.0, t: str = "UpdatedAt", windows: Sequence[tuple[int, int]] = WINDOWS) -> DataFrame:
    """Adds time_window, like "15-30s", to the rows within one; the first starts after what is skipped."""
    label = None
    for a, b in windows:
        inside = (F.col(t) >= (skip if a == 0 else a)) & (F.col(t) < b)
        label = F.when(inside, f"{a}-{b}s") if label is None else label.when(inside, f"{a}-{b}s")
    return df.withColumn("time_window", label).where("time_window is not null")


def center_distance(df: DataFrame, x: str = "BotPosX", y: str = "BotPosY") -> DataFrame:
    return df.withColumn("DistanceFromCenter", S.distance(F.col(x), F.col(y), F.lit(CENTER_X), F.lit(CENTER_Y)))


def centered(df: DataFrame, x: str = "BotPosX", y: str = "BotPosY") -> DataFrame:
    return df.withColumns({x: F.col(x) - CENTER_X, y: F.col(y) - CENTER_Y})


def pair_distance(df: DataFrame, keys: Sequence[str] = GAME, t: str = "UpdatedAt", actor: str = "Actor", x: str = "BotPosX", y: str = "BotPosY", keep: Sequence[str] = ()) -> DataFrame:
    """Both sides' positions at the same time of the same game, and their distance."""
    side = lambda a, i: df.where(F.col(actor) == a).select(*keys, t, *(keep if i == 1 else ()), F.col(x).alias(f"Bot{i}_X"), F.col(y).alias(f"Bot{i}_Y"))
    joined = side(0, 1).join(side(1, 2), [*keys, t])
    return joined.withColumn("Distance", S.distance(*[F.col(c) for c in ("Bot1_X", "Bot1_Y", "Bot2_X", "Bot2_Y")]))


def distance_over_time(df: DataFrame, timer: Column, value: str = "Distance", t: str = "UpdatedAt", bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Timer, bin, mid, mean, std, n: values by equal parts of [0, timer); empty parts have no row, one value's std is 0."""
    width = timer / bins
    rows = df.where((F.col(t) >= 0) & (F.col(t) < timer)).select(*by, timer.alias("Timer"), F.floor(F.col(t) / width).cast("int").alias("bin"), F.col(value).alias("v"))
    out = rows.groupBy(*by, "Timer", "bin").agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.count("v").alias("n"))
    return out.withColumn("mid", (F.col("bin") + 0.5) * F.col("Timer") / bins)


def both_sides(distances: DataFrame) -> DataFrame:
    """Each pair distance once for either competitor."""
    return distances.withColumn("Bot", F.explode(F.array("Bot_L", "Bot_R")))
