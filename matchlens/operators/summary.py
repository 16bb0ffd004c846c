"""Roll-ups: games to matchups, matchups to competitors, and both sides of a table as one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.schema import DIMENSIONS, TOTALS
from ..sources.shared import shared_folder, written
from .ranks import tied


def average_rank(df: DataFrame, by: str, name: str = "Rank") -> DataFrame:
    """Descending ranks; ties share their mean rank, cut to a whole number. Nulls have none; NaN is the greatest. See ranks.tied.

    df is computed twice and must give the same values each time: sums of doubles don't, unless they are written first.
    """
    known = tied(df, F.col(by), descending=True)
    joined = df.join(known, F.col(by) == F.col("_value"), "left")
    return joined.withColumn(name, (F.col("_before") + 1 + F.floor((F.col("_ties") - 1) / 2)).cast("int")).drop("_value", "_before", "_ties")


def sides(df: DataFrame, pairs: Mapping[str, tuple[str, str]], keep: Sequence[str] = (), side: str | None = "Side") -> DataFrame:
    """Each row twice: with the left and with the right column of each pair under the pair's name.

    Both come from one pass over df; a pair's columns are of one type.
    """
    half = lambda i: F.struct(*([F.lit("LR"[i]).alias(side)] if side else []), *[F.col(p[i]).alias(k) for k, p in pairs.items()])
    return df.select(*keep, F.inline(F.array(half(0), half(1))))


def matchup_parts(games: DataFrame, keys: Sequence[str] = tuple(DIMENSIONS)) -> DataFrame:
    """What matchup_summary is made of: counts and sums of each configuration, from one row a game. Parts of different games can be added."""
    dynamic = [c for c in games.columns if "_Act_" in c or "_Dur_" in c]
    return games.groupBy(*keys).agg(
        F.count("*").alias("Games"), F.count_if(F.col("Winner") == 0).alias("Winner_L"), F.count_if(F.col("Winner") == 1).alias("Winner_R"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*TOTALS, *dynamic] if c in games.columns],
        F.count("MatchDur").alias("Timed"), F.coalesce(F.sum("MatchDur"), F.lit(0.0)).alias("TimeSum"),
    )


def added(parts: DataFrame, keys: Sequence[str] = tuple(DIMENSIONS)) -> DataFrame:
    """Parts of the same configurations as one row each."""
    return parts.groupBy(*keys).agg(*[F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in parts.columns if c not in keys])


def finished(parts: DataFrame, ranks: bool = True) -> DataFrame:
    """Matchup summaries from parts: mean duration and win rates, and with `ranks` the pooled ranks of both sides."""
    rate = lambda wins: F.try_divide(F.col(wins).cast("double"), F.col("Games").cast("double"))
    out = parts.withColumns({"MatchDur": F.try_divide(F.col("TimeSum"), F.col("Timed").cast("double")), "WinRate_L": rate("Winner_L"), "WinRate_R": rate("Winner_R")}).drop("Timed", "TimeSum")
    if not ranks:
        return out
    known = competitor_ranks(out).select("Bot", "Rank")
    for side in ("L", "R"):
        out = out.join(known.withColumnsRenamed({"Bot": f"Bot_{side}", "Rank": f"Rank_{side}"}), f"Bot_{side}", "left")
    return out


def matchup_summary(games: DataFrame, keys: Sequence[str] = tuple(DIMENSIONS)) -> DataFrame:
    """Games, wins, summed metrics, mean duration, win rates and pooled ranks of each configuration of a matchup; from one row a game."""
    return finished(matchup_parts(games, keys))


def competitor_ranks(matchups: DataFrame) -> DataFrame:
    """Bot, Wins, Games, WinRate, Rank: pooled over both sides."""
    both = sides(matchups, {"Bot": ("Bot_L", "Bot_R"), "Wins": ("Winner_L", "Winner_R")}, ["Games"], None)
    out = both.groupBy("Bot").agg(F.sum("Wins").alias("Wins"), F.sum("Games").alias("Games"))
    return average_rank(out.withColumn("WinRate", F.try_divide(F.col("Wins").cast("double"), F.col("Games").cast("double"))), "WinRate")


def competitor_stats(matchups: DataFrame, ranks: bool = True) -> DataFrame:
    """Mean and sample deviation over a competitor's matchup rows, on either side; with `ranks` the rank by mean win rate."""
    own = matchups.withColumns({"Hits_L": F.col("Collisions_L") + F.col("Collisions_Tie"), "Hits_R": F.col("Collisions_R") + F.col("Collisions_Tie")})
    pairs = {"Bot": ("Bot_L", "Bot_R"), "WinRate": ("WinRate_L", "WinRate_R"), "Duration": ("Duration_L", "Duration_R"), "Actions": ("ActionCounts_L", "ActionCounts_R"), "Collisions": ("Hits_L", "Hits_R")}
    both = sides(own, pairs, ["Games"], None)
    per_game = lambda c: F.try_divide(F.col(c).cast("double"), F.col("Games").cast("double"))
    both = both.withColumns({c: per_game(c) for c in ("Duration", "Actions", "Collisions")})
    metrics = ("WinRate", "Duration", "Actions", "Collisions")
    out = both.groupBy("Bot").agg(*[x for c in metrics for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])
    # A row a competitor, written: a mean added up again in another order has other last digits, and would find no rank.
    return average_rank(written(out, shared_folder(matchups.sparkSession)), "WinRate_mean") if ranks else out


def competitor_summary(matchups: DataFrame) -> DataFrame:
    """Rank, Bot and four labels "mean (std)", by rank."""
    label = lambda c, name: S.mean_std_label(F.col(f"{c}_mean"), F.col(f"{c}_std")).alias(name)
    out = competitor_stats(matchups)
    return out.select("Rank", "Bot", label("WinRate", "Win-rate"), label("Duration", "Action Duration"), label("Actions", "Actions"), label("Collisions", "Collisions")).orderBy("Rank", "Bot")
