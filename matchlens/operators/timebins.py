"""Counts of events in bins of time, with zeros where a bin has none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .games import KEYS
from .spans import same


def bin_of(t: Column, width: float) -> Column:
    """The start of the bin that holds t: bins are closed on the right, the first on both sides."""
    return F.when(t == 0, 0.0).when(t > 0, (F.ceil(t / width) - 1) * F.lit(float(width)))


def _domain(keyed: DataFrame, width: float) -> DataFrame:
    """All bins of each row, from its column longest."""
    bins = F.ceil(F.col("longest") / width)
    return keyed.where("longest > 0").select("*", F.explode(F.sequence(F.lit(0), (bins - 1).cast("int"))).alias("_k")).withColumn("TimeBin", F.col("_k") * F.lit(float(width))).drop("_k", "longest")


def _with_longest(groups: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups of games with the time of their game's last event."""
    own = [f"_k{i}" for i in range(len(keys))]
    longest = events.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)]).agg(F.max("UpdatedAt").alias("longest"))
    return groups.join(longest, same(keys, own)).drop(*own)


def _filled(domain: DataFrame, counts: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All of the domain with its counts, 0 where there are none."""
    own = [f"_b{i}" for i in range(len(by))]
    renamed = counts.withColumnsRenamed(dict(zip(by, own)))
    return domain.join(renamed, same(by, own), "left").drop(*own).withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in columns})


def action_fragments(events: DataFrame, width: float = 5.0, keys: Sequence[str] = KEYS, dimensions: Sequence[str] = ()) -> DataFrame:
    """keys, Actor, dimensions, Action, TimeBin, Count: for every bin of a game and every action its side has there.

    Events aren't dealt by game: tasks count their own, and only counts are shuffled.
    """
    keys = [k for k in keys if k in events.columns]
    rows = events.where("Category = 'Action'").where(F.col("State").try_cast("int") != 2)
    rows = rows.select(*keys, "Actor", *dimensions, F.col("Name").alias("Action"), bin_of(F.col("UpdatedAt"), width).alias("TimeBin")).where("Action is not null")
    group = [*keys, "Actor", "Action"]
    counts = rows.groupBy(*group, "TimeBin").agg(F.count("*").alias("Count"))
    names = rows.groupBy(*group).agg(*[F.max(d).alias(d) for d in dimensions], F.lit(1).alias("_one")).drop("_one")
    return _filled(_domain(_with_longest(names, events, keys), width), counts, [*group, "TimeBin"], ["Count"])


def collision_fragments(events: DataFrame, width: float = 5.0, keys: Sequence[str] = KEYS, dimensions: Sequence[str] = (), legacy_side_labels: bool = False) -> DataFrame:
    """keys, dimensions, TimeBin, Actor_L, Actor_R, Tie for every bin of a game with collisions.

    With legacy_side_labels the sides' names are swapped, as some earlier tables have them. Only counts are shuffled.
    """
    keys = [k for k in keys if k in events.columns]
    rows = events.where("Category = 'Collision'").where(F.col("State").try_cast("int") == 0)
    tie = F.coalesce(F.col("ColTieBreaker"), F.lit(0))
    struck = (tie == 0) & (F.col("ColActor") == 1)
    sides = ("R", "L") if legacy_side_labels else ("L", "R")
    counts = rows.groupBy(*keys, bin_of(F.col("UpdatedAt"), width).alias("TimeBin")).agg(
        *[F.count_if(struck & (F.col("Actor") == i)).alias(f"Actor_{s}") for i, s in enumerate(sides)], F.sum(tie).cast("long").alias("Tie")
    )
    games = rows.groupBy(*keys).agg(*[F.max(d).alias(d) for d in dimensions], F.lit(1).alias("_one")).drop("_one")
    return _filled(_domain(_with_longest(games, events, keys), width), counts, [*keys, "TimeBin"], ["Actor_L", "Actor_R", "Tie"])


def action_bins(fragments: DataFrame, by: Sequence[str] = ("Bot", "Timer", "ActInterval", "Round")) -> DataFrame:
    """The mean count of each bin and action."""
    return fragments.groupBy(*by, "TimeBin", "Action").agg(F.avg("Count").alias("MeanCount")).orderBy(*by, "TimeBin", "Action")


def collision_bins(fragments: DataFrame, by: Sequence[str] = ("Bot_L", "Bot_R", "Timer", "ActInterval", "Round")) -> DataFrame:
    """The summed counts of each bin."""
    return fragments.groupBy(*by, "TimeBin").agg(*[F.sum(c).alias(c) for c in ("Actor_L", "Actor_R", "Tie")]).orderBy(*by, "TimeBin")
