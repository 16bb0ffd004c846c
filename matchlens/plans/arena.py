"""Frames of positions and distances for each competitor, ready to plot: heat maps, histograms, or all of them.

Rows have Bot, GameIndex, UpdatedAt, BotPosX and BotPosY. All competitors are worked on in one pass, keyed by Bot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import stats
from ..operators import spatial
from ..sources.logs import limit_configs
from ..sources.shared import shared_folder, written

MODES = ("heatmap", "position", "distance", "all")


def heatmaps(rows: DataFrame, by: Sequence[str] = ("Bot",), phases: int | None = None, keys: Sequence[str] = spatial.GAME, quantile: float | None = None) -> DataFrame:
    """by (and phase), ix, iy, x, y, density around the arena's centre; below a quantile of its map density is null.

    by may be Bot, Bot and Timer, or nothing for one map of all files.
    """
    if phases:
        rows, by = spatial.with_phase(rows, phases, keys), [*by, "phase"]
    grid = stats.kde2d(spatial.centered(rows), "BotPosX", "BotPosY", spatial.RADIUS + 1, by=list(by))
    return grid if quantile is None else stats.masked_density(grid, quantile, list(by))


def combined_heatmap(rows: DataFrame, actor: int | None = 0, phases: int | None = None, keys: Sequence[str] = spatial.GAME) -> DataFrame:
    """One map of all files together, of one actor (0, the left one) or of both (None)."""
    return heatmaps(rows if actor is None else rows.where(F.col("Actor") == actor), (), phases, keys)


def position_histograms(rows: DataFrame, bins: int = 30, by: Sequence[str] = ("Bot",)) -> DataFrame:
    """by, axis (X or Y), bin, start, stop, count, density of the positions along both axes."""
    long = rows.select(*by, "BotPosX", "BotPosY").unpivot(list(by), ["BotPosX", "BotPosY"], "axis", "value").withColumn("axis", F.substring("axis", 7, 1))
    return stats.histogram(long, "value", bins, [*by, "axis"])


def distance_histograms(rows: DataFrame, keys: Sequence[str] = spatial.GAME, bins: int = 30, shared: bool = False) -> DataFrame:
    """Bot, kind (pair or center), bin, start, stop, count, density of both sides' distance and of the distance from the centre.

    With `shared` all competitors have the edges of the whole, by kind.
    """
    center = spatial.center_distance(rows).select("Bot", F.lit("center").alias("kind"), F.col("DistanceFromCenter").alias("value"))
    pair = competitor_distances(rows, keys).select("Bot", F.lit("pair").alias("kind"), F.col("Distance").alias("value"))
    if not shared:
        return stats.histogram(pair.unionByName(center), "value", bins, ["Bot", "kind"])
    each = [stats.histogram(x, "value", bins, ["Bot", "kind"], shared=True) for x in (pair, center)]
    return each[0].unionByName(each[1])


def competitor_distances(rows: DataFrame, keys: Sequence[str] = spatial.GAME) -> DataFrame:
    """keys, UpdatedAt, Bot, Opponent, Distance: each pair distance once for either competitor. Rows have Actor too."""
    pairs = spatial.pair_distance(rows, keys, keep=["Bot"]).withColumnRenamed("Bot", "Bot_L")
    other = rows.where("Actor = 1").select(*keys, "UpdatedAt", F.col("Bot").alias("Bot_R"))
    return spatial.both_sides(pairs.join(other, [*keys, "UpdatedAt"])).select(*keys, "UpdatedAt", "Bot", F.when(F.col("Bot") == F.col("Bot_L"), F.col("Bot_R")).otherwise(F.col("Bot_L")).alias("Opponent"), "Distance")


def frames(rows: DataFrame, mode: str = "all", keys: Sequence[str] = spatial.GAME, phases: int | None = 3) -> dict[str, DataFrame]:
    """The frames of all competitors by name, for one of MODES."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    out = {}
    if mode in ("heatmap", "all"):
        out |= {"heatmap": heatmaps(rows), "combined": heatmaps(rows, by=())} | ({"phased": heatmaps(rows, phases=phases, keys=keys)} if phases else {})
    if mode in ("position", "all"):
        out["position"] = position_histograms(rows)
    if mode in ("distance", "all"):
        out["distance"] = distance_histograms(rows, keys)
    return out


#: The levels that maps are made for, and what tells a level's parts apart.
LEVELS = ("all", "timer", "phase", "window")


def leveled(rows: DataFrame, levels: Sequence[str] = LEVELS, keys: Sequence[str] = spatial.GAME, phases: int = 3, skip: float = 0.0) -> DataFrame:
    """Each row once for every level that it counts for, with level and part: one pass for all levels.

    Parts are "" of all, the timer's number, the phase from 0, or a time window like "15-30s"; the first window starts
    after what is skipped and is named so. Rows outside all windows, or without a timer, don't count there.
    """
    if unknown := set(levels) - set(LEVELS):
        raise ValueError(f"unknown levels {sorted(unknown)}")
    if "phase" in levels:
        rows = spatial.with_phase(rows, phases, keys)
    windows = F.lit(None).cast("string")
    for a, b in reversed(spatial.WINDOWS):
        start = skip if a == 0 and skip else a
        windows = F.when((F.col("UpdatedAt") >= start) & (F.col("UpdatedAt") < b), f"{start}-{b}s").otherwise(windows)
    part = {"all": F.lit(""), "timer": S.ten_digits(F.col("Timer")) if "timer" in levels else None, "phase": F.col("phase").cast("string") if "phase" in levels else None, "window": windows}
    tags = F.array(*[F.struct(F.lit(x).alias("level"), part[x].alias("part")) for x in levels])
    out = rows.select("*", F.inline(F.filter(tags, lambda t: t["part"].isNotNull())))
    return out.drop("phase")


def all_modes(
    rows: DataFrame, mode: str = "all", levels: Sequence[str] = LEVELS, keys: Sequence[str] = spatial.GAME, phases: int = 3, skip: float = 0.0, max_configs: int | None = None,
    side: str = "both", over_time: bool = True, cells: int = 100, points: int = 200, quantile: float | None = None,
) -> dict[str, DataFrame]:
    """All frames of all competitors, by name, for one of MODES. Rows have Timer, Actor and, if a side is asked for, Side; matchup and config if max_configs is.

    heatmap (Bot, level, part, ix, iy, x, y, density) and marginal (Bot, level, part, axis, i, x, density) for all levels
    in one density sum each; position and distance histograms; over_time (Bot, Timer, bin, mid, mean, std, n) if the level
    timer is asked for. What lies less than `skip` after a game's first row counts for none but over_time. Rows are read
    once, and written to the shared folder for all frames.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if side not in ("left", "right", "both"):
        raise ValueError(f"unknown side {side!r}")
    rows = rows if max_configs is None else limit_configs(rows, max_configs)
    needed = list(dict.fromkeys(["Bot", *keys, "UpdatedAt", "Actor", "BotPosX", "BotPosY", "Timer", *(["Side"] if side != "both" else [])]))
    rows = written(rows.select(*needed), shared_folder(rows.sparkSession))
    late = spatial.skip_initial(rows, skip, keys) if skip > 0 else rows
    mine = late if side == "both" else late.where(F.col("Side") == side[0].upper())
    out, by = {}, ["Bot", "level", "part"]
    if mode in ("heatmap", "all"):
        tagged = written(spatial.centered(leveled(mine, levels, keys, phases, skip)).select(*by, "BotPosX", "BotPosY"), shared_folder(rows.sparkSession))
        grid = stats.kde2d(tagged, "BotPosX", "BotPosY", spatial.RADIUS + 1, cells, by)
        out["heatmap"] = grid if quantile is None else stats.masked_density(grid, quantile, by)
        axes = tagged.unpivot(by, ["BotPosX", "BotPosY"], "axis", "value").withColumn("axis", F.substring("axis", 7, 1))
        out["marginal"] = stats.kde1d(axes, "value", points, [*by, "axis"])
        if over_time and "timer" in levels:
            pairs = spatial.pair_distance(rows, [*keys], keep=["Timer", "Bot"])
            other = rows.where("Actor = 1").select(*keys, "UpdatedAt", F.col("Bot").alias("Other"))
            both = pairs.join(other, [*keys, "UpdatedAt"]).withColumn("Bot", F.explode(F.array("Bot", "Other")))
            out["over_time"] = spatial.distance_over_time(both, F.col("Timer"), by=["Bot"])
    if mode in ("position", "all"):
        out["position"] = position_histograms(mine)
    if mode in ("distance", "all"):
        out["distance"] = distance_histograms(late, keys)
    return out
