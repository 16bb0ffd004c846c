"""Report queries over the matchup summary and the time bins: each gives a frame that is ready to plot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import quantiles, stats
from ..operators.ranks import places
from ..operators.summary import sides
from ..sources.schema import ACTIONS
from ..sources.shared import shared_folder, written

CONFIG = ["Timer", "ActInterval", "Round", "SkillLeft", "SkillRight"]
PER_GAME = ("Collisions", "ActionCounts", "Duration")
# The groups of actions shown together.
MIX = {"Accelerate": ["Accelerate"], "TurnLeft": ["TurnLeft"], "TurnRight": ["TurnRight"], "Dash": ["Dash"], "Skill": ["SkillBoost", "SkillStone"]}


def filtered(df: DataFrame, **values) -> DataFrame:
    """Rows with the given value, or one of a list, in each named column; None is no filter."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name).isin(value) if isinstance(value, list | tuple | set) else F.col(name) == value)
    return df


def domain(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def ordered_domain(df: DataFrame, bot: str = "Bot_L", rank: str = "Rank_L") -> DataFrame:
    """ranked_domain with each competitor's place in that order, from 1: the order as a column, for tables that keep none."""
    rows = df.groupBy(F.col(bot).alias("Bot")).agg(F.coalesce(F.min(rank), F.lit(9999)).alias("Rank"))
    return places(rows, F.struct("Rank", "Bot"), "place")


def ranked_domain(df: DataFrame, bot: str = "Bot_L", rank: str = "Rank_L") -> DataFrame:
    """Competitors by rank; those without one last, as 9999."""
    return df.groupBy(F.col(bot).alias("Bot")).agg(F.coalesce(F.min(rank), F.lit(9999)).alias("Rank")).orderBy("Rank", "Bot")


def head_to_head(df: DataFrame, bot: str) -> DataFrame:
    """Enemy, WinRate: the mean of the mean rates as left and as right."""
    half = lambda own, other, rate: df.where(F.col(own) == bot).groupBy(F.col(other).alias("Enemy")).agg(F.avg(rate).alias("r"))
    both = half("Bot_L", "Bot_R", "WinRate_L").union(half("Bot_R", "Bot_L", "WinRate_R"))
    return both.groupBy("Enemy").agg(F.avg("r").alias("WinRate"))


def winrate_pairs(df: DataFrame) -> DataFrame:
    """Bot, Enemy, WinRate over both directions, and Rank, in long form."""
    both = sides(df, {"Bot": ("Bot_L", "Bot_R"), "Enemy": ("Bot_R", "Bot_L"), "WinRate": ("WinRate_L", "WinRate_R"), "Rank": ("Rank_L", "Rank_R")}, (), None)
    return both.groupBy("Bot", "Enemy").agg(F.avg("WinRate").alias("WinRate"), F.min("Rank").alias("Rank"))


def winrate_matrix(df: DataFrame, enemies: Sequence[str]) -> DataFrame:
    """A row a competitor, a column for each of the enemies: the mean over both directions. Ranks aren't looked at."""
    both = sides(df, {"Bot": ("Bot_L", "Bot_R"), "Enemy": ("Bot_R", "Bot_L"), "WinRate": ("WinRate_L", "WinRate_R")}, (), None)
    return both.groupBy("Bot").pivot("Enemy", list(enemies)).agg(F.avg("WinRate"))


def duration_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.avg("MatchDur").alias("MatchDur"))


def top_actions(df: DataFrame, n: int = 6, side: str = "L") -> DataFrame:
    """Bot, Action, Count, place: the n most frequent actions of each competitor; ties by name."""
    columns = [c for c in df.columns if c.endswith(f"_Act_{side}")]
    sums = df.groupBy(F.col(f"Bot_{side}").alias("Bot")).agg(*[F.sum(c).alias(c) for c in columns])
    long = sums.unpivot("Bot", columns, "Action", "Count").withColumn("Action", F.regexp_replace("Action", f"_Act_{side}$", ""))
    order = Window.partitionBy("Bot").orderBy(F.desc("Count"), "Action")
    return long.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def winrate_by(df: DataFrame, config: str = "Timer") -> DataFrame:
    both = sides(df, {"Bot": ("Bot_L", "Bot_R"), "WinRate": ("WinRate_L", "WinRate_R")}, [config], None)
    return both.groupBy("Bot", config).agg(F.avg("WinRate").alias("WinRate"))


def action_intensity(bins: DataFrame, mode: str = "total", action: str | Sequence[str] | None = None, by: str = "Bot", **filters) -> DataFrame:
    """by, TimeBin (and Action): the mean count; mode total, per_action or select (of the named actions)."""
    if mode not in ("total", "per_action", "select"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "select" and not action:
        raise ValueError("mode select needs an action")
    rows = filtered(bins, **filters).withColumn("TimeBin", F.col("TimeBin").try_cast("double")).dropna(subset=["TimeBin"])
    if mode == "select":
        rows = filtered(rows, Action=[action] if isinstance(action, str) else list(action))
    keys = [by, "TimeBin"] if mode == "total" else [by, "TimeBin", "Action"]
    return rows.groupBy(*keys).agg(F.avg("MeanCount").alias("MeanCount"))


def collision_intensity(bins: DataFrame, mode: str = "total", kind: str | None = None, by: str = "Bot_L", **filters) -> DataFrame:
    """by, TimeBin (and Type): mean collisions; mode total (of all kinds' sum), per_type or select (one kind)."""
    kinds = ["Actor_L", "Actor_R", "Tie"]
    if mode not in ("total", "per_type", "select"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "select" and kind not in kinds:
        raise ValueError(f"unknown collision type {kind!r}")
    rows = filtered(bins, **filters).withColumn("TimeBin", F.col("TimeBin").try_cast("double")).dropna(subset=["TimeBin"])
    if mode == "total":
        return rows.groupBy(by, "TimeBin").agg(F.avg(F.col("Actor_L") + F.col("Actor_R") + F.col("Tie")).alias("MeanCount"))
    long = rows.unpivot([by, "TimeBin"], kinds if mode == "per_type" else [kind], "Type", "Count")
    return long.groupBy(by, "TimeBin", "Type").agg(F.avg("Count").alias("MeanCount"))


def config_cross(df: DataFrame, bot: str | None = None, key: str = "WinRate_L", max_labels: int = 40) -> DataFrame:
    """X, Y, value: the mean metric of pairs of settings that met the same value, made symmetric.

    Settings are first counted by value, so that a frequent value gives few rows to join.
    """
    rows = df if bot is None else df.where(F.col("Bot_L") == bot)
    text = [F.col(c).cast("string").alias(c) for c in CONFIG]
    long = rows.select(key, *text).unpivot(key, CONFIG, "Type", "Setting").dropna(subset=[key, "Setting"])
    counts = long.groupBy(F.col(key).alias("k"), "Type", "Setting").agg(F.count("*").alias("n"))
    side = lambda s: counts.select("k", F.col("Type").alias(f"Type_{s}"), F.concat("Type", F.lit("="), "Setting").alias(s), F.col("n").alias(f"n_{s}"))
    pairs = side("X").join(side("Y"), "k").where("Type_X <> Type_Y")
    weight = F.col("n_X") * F.col("n_Y")
    grouped = pairs.groupBy("X", "Y").agg((F.sum(F.col("k") * weight) / F.sum(weight)).alias("v"))
    grouped = written(grouped, shared_folder(df.sparkSession))  # a row for each pair of settings
    for s in ("X", "Y"):  # the first labels by name: a top k, of which each task sends its own
        first = grouped.select(F.col(s).alias("_first")).distinct().orderBy("_first").limit(max_labels)
        grouped = grouped.join(F.broadcast(first), F.col(s) == F.col("_first"), "left_semi")
    turned = grouped.select(F.col("X").alias("Y"), F.col("Y").alias("X"), F.col("v").alias("w"))
    return grouped.join(turned, ["X", "Y"]).select("X", "Y", ((F.col("v") + F.col("w")) / 2).alias("value"))


def _metric(metric: str) -> Column:
    return F.try_divide(F.col(metric).cast("double"), F.col("Games").cast("double")) if any(x in metric for x in PER_GAME) else F.col(metric).cast("double")


def metric_by_config(df: DataFrame, metric: str = "WinRate_L", config: str = "Timer", bot: str = "Bot_L", fill: bool = False) -> DataFrame:
    """bot, config, mean, std. Collisions, actions and durations count by game; config Skill takes both sides.

    With `fill` every competitor has a row for every value of the setting, with mean 0 where it has no matchup.
    """
    if config == "Skill":
        other = lambda c: c.replace("_L", "_R")
        rows = df.select(F.col(bot).alias("Bot"), F.col("SkillLeft").alias("Config"), _metric(metric).alias("v"))
        rows = rows.union(df.select(F.col(other(bot)), F.col("SkillRight"), _metric(other(metric))))
    else:
        rows = df.select(F.col(bot).alias("Bot"), F.col(config).alias("Config"), _metric(metric).alias("v"))
    out = rows.groupBy("Bot", "Config").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"), F.stddev_samp("v").alias("std"))
    if not fill:
        return out
    out = written(out, shared_folder(df.sparkSession))
    values = out.agg(F.collect_set("Config").alias("values"))  # one row: a setting has few values
    every = out.select("Bot").distinct().join(F.broadcast(values)).select("Bot", F.explode("values").alias("Config"))
    return every.join(out, ["Bot", "Config"], "left").fillna(0.0, ["mean"])


def metric_overall(df: DataFrame, metric: str = "Collisions_L", bot: str = "Bot_L") -> DataFrame:
    return df.select(F.col(bot).alias("Bot"), _metric(metric).alias("v")).groupBy("Bot").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def grouped_error(df: DataFrame, key: str = "WinRate", by: str = "ActInterval", error: str = "std") -> DataFrame:
    """Bot, by, mean, n, error (std, se or ci: 95 %), Rank (9999 if none); a single row's error is 0."""
    if error not in ("std", "se", "ci"):
        raise ValueError(f"unknown error {error!r}")
    both = sides(df, {"Bot": ("Bot_L", "Bot_R"), "v": (f"{key}_L", f"{key}_R"), "Rank": ("Rank_L", "Rank_R")}, [by], None)
    out = both.groupBy("Bot", by).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("n"), F.coalesce(F.min("Rank"), F.lit(9999)).alias("Rank"))
    width = F.coalesce("std", F.lit(0.0))
    width = width if error == "std" else F.try_divide(width, F.sqrt("n")) * (1.96 if error == "ci" else 1.0)
    return out.select("Bot", by, "mean", "n", F.coalesce(width, F.lit(0.0)).alias("error"), "Rank")


def action_radar(df: DataFrame, scale: str | None = None) -> DataFrame:
    """Bot, Axis, value, limit: mean actions as left, both skills as one; limit is 1.15 times the (exact) 95th percentile of all values."""
    columns = [sum((F.avg(f"{a}_Act_L") for a in parts[1:]), F.avg(f"{parts[0]}_Act_L")).alias(k) for k, parts in MIX.items()]
    long = df.groupBy(F.col("Bot_L").alias("Bot")).agg(*columns).unpivot("Bot", list(MIX), "Axis", "value").withColumn("value", S.scaled(F.col("value"), scale))
    long = written(long, shared_folder(df.sparkSession))
    limit = quantiles.exact(long, "value", {"limit": 0.95})  # one row
    return long.join(F.broadcast(limit), how="left").withColumn("limit", F.col("limit") * 1.15)


def collision_radar(df: DataFrame, scale: str | None = None) -> DataFrame:
    """Bot, hit, tie, being_hit, from a competitor's rows as left."""
    out = df.groupBy(F.col("Bot_L").alias("Bot")).agg(F.sum("Collisions_L").alias("hit"), F.sum("Collisions_Tie").alias("tie"), F.sum("Collisions_R").alias("being_hit"))
    return out.select("Bot", *[S.scaled(F.col(c), scale).alias(c) for c in ("hit", "tie", "being_hit")])


def mix(df: DataFrame, parts: dict[str, list[str]], normalize: bool = False) -> DataFrame:
    """Bot and a sum for each part; as percent of their sum if normalised."""
    out = df.groupBy(F.col("Bot_L").alias("Bot")).agg(*[F.sum(sum((F.col(c) for c in cs[1:]), F.col(cs[0]))).alias(k) for k, cs in parts.items()])
    if not normalize:
        return out
    whole = sum((F.col(k) for k in list(parts)[1:]), F.col(next(iter(parts))))
    return out.select("Bot", *[S.percent(F.col(k), whole).alias(k) for k in parts])


def action_mix(df: DataFrame, normalize: bool = False) -> DataFrame:
    return mix(df, {k: [f"{a}_Act_L" for a in parts] for k, parts in MIX.items()}, normalize)


def collision_mix(df: DataFrame, normalize: bool = False) -> DataFrame:
    return mix(df, {"hit": ["Collisions_L"], "tie": ["Collisions_Tie"], "being_hit": ["Collisions_R"]}, normalize)


def correlation_rows(df: DataFrame, per_game_actions: bool = True) -> DataFrame:
    """Both sides of each matchup with the columns that are correlated; own and enemy collisions follow the side.

    Actions count by game, or in sum for reports on one competitor.
    """
    pairs = {"Bot": ("Bot_L", "Bot_R"), "WinRate": ("WinRate_L", "WinRate_R"), "Actions": ("ActionCounts_L", "ActionCounts_R"), "Duration": ("Duration_L", "Duration_R"), "Collisions": ("Collisions_L", "Collisions_R"), "EnemyCollisions": ("Collisions_R", "Collisions_L"), "Skill": ("SkillLeft", "SkillRight")}
    pairs |= {f"{a}_{k}": (f"{a}_{k}_L", f"{a}_{k}_R") for a in ACTIONS for k in ("Act", "Dur") if f"{a}_{k}_L" in df.columns}
    out = sides(df, pairs, ["Games", "Timer", "ActInterval", "Round", "Collisions_Tie"])
    if per_game_actions:
        out = out.withColumns({c: F.try_divide(F.col(c).cast("double"), F.col("Games").cast("double")) for c in pairs if c.endswith("_Act")})
    return out.withColumns({"RoundNumeric": S.trailing_number(F.col("Round")), "SkillNumeric": S.skill_number(F.col("Skill")), "TotalSkillAct": F.col("SkillBoost_Act") + F.col("SkillStone_Act")})


def correlations(rows: DataFrame, xs: Sequence[str], y: str = "WinRate", by: Sequence[str] = (), p_values: bool = False) -> DataFrame:
    """by, x, n, r, slope, intercept (and p) for each column of xs against y."""
    long = rows.select(*by, F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(x) for x in xs]).unpivot([*by, "y"], list(xs), "x", "v").dropna(subset=["y", "v"])
    slope, intercept = stats.line("v", "y")
    out = long.groupBy(*by, "x").agg(F.count("*").alias("n"), stats.pearson("v", "y").alias("r"), slope.alias("slope"), intercept.alias("intercept"))
    return out.withColumn("p", stats.pearson_p(F.col("r"), F.col("n").cast("double"))) if p_values else out


def individual_rows(df: DataFrame, bot: str) -> DataFrame:
    return correlation_rows(df, per_game_actions=False).where(F.col("Bot") == bot)


def regression_line(fit: DataFrame, lo: Column, hi: Column, clip: bool = False) -> DataFrame:
    """The ends of each fitted line, cut to [0, 1] for reports on one competitor."""
    at = lambda x: F.col("slope") * x + F.col("intercept")
    cut = S.clipped if clip else (lambda c: c)
    return fit.withColumns({"y_lo": cut(at(lo)), "y_hi": cut(at(hi))})
