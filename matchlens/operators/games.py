"""Metrics of each game, from its events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import ACTIONS
from .spans import MOST, sliced

#: What identifies a game. GameIndex alone is only unique within a file.
KEYS = ("source_file", "GameIndex")


def with_actual_duration(events: DataFrame, keys: Sequence[str] = KEYS, tiebreak: Sequence[str] = ("round_pos", "event_pos"), most: int | None = MOST) -> DataFrame:
    """Adds ActualDuration: for an end (state 2) the time since the start of the event before it, of the same actor and name; else 0.

    A game of over `most` events is dealt to ranges of its time; the last event of each range is carried over to the next
    range that has one of its kind. Without `most` each game is in one task, and nothing is read twice.
    """
    kind = [*keys, "Category", "Actor", "Name"]
    order = ["UpdatedAt", *[c for c in tiebreak if c in events.columns]]
    if most is None:
        before = F.lag("StartedAt").over(Window.partitionBy(*kind).orderBy(*order))
        return _durations(events.repartition(*keys), before)
    rows, place = sliced(events, keys, most=most), [*keys, "_slice"]
    ends = sliced(events.select(*kind, "StartedAt", *order), keys, most=most).where("_slice is not null")  # large games only
    ends = ends.repartition(*place).groupBy(*kind, "_slice").agg(F.max_by("StartedAt", F.struct(*order)).alias("_end"))
    # What a range hands on is a row before the first of its kind in the next range: no range, nor a game, is joined.
    handed = ends.withColumn("StartedAt", F.lag("_end").over(Window.partitionBy(*kind).orderBy("_slice"))).drop("_end").withColumn("_handed", F.lit(1))
    rows = rows.withColumn("_handed", F.lit(0)).unionByName(handed, allowMissingColumns=True).repartition(*place)
    before = F.lag("StartedAt").over(Window.partitionBy(*kind, "_slice").orderBy(F.desc("_handed"), *order))
    return _durations(rows, before).where("_handed = 0").drop("_handed", "_slice")


def _durations(rows: DataFrame, before: Column) -> DataFrame:
    ended = (F.col("State").try_cast("int") == 2) & F.col("_before").isNotNull()
    return rows.withColumn("_before", before).withColumn("ActualDuration", F.when(ended, F.col("UpdatedAt") - F.col("_before")).otherwise(0.0)).drop("_before")


def _side(side: str) -> Column:
    return F.col("Actor") == (0 if side == "L" else 1)


def action_columns(acts: Column, actions: Sequence[str] = tuple(ACTIONS)) -> list[Column]:
    """Aggregates: durations and counts by side and action, 0 where a side has none; null in games without actions."""
    counted = acts & (F.col("State").try_cast("int") != 2)
    any_act = F.count_if(acts) > 0
    put = lambda value, when: F.coalesce(F.sum(F.when(when, value)), F.lit(0))
    out = []
    for side in ("L", "R"):
        out.append(F.when(any_act, put(F.col("ActualDuration"), acts & _side(side))).cast("double").alias(f"Duration_{side}"))
        out += [F.when(any_act, put(F.col("ActualDuration"), acts & _side(side) & (F.col("Name") == a))).cast("double").alias(f"{a}_Dur_{side}") for a in actions]
    for side in ("L", "R"):
        out.append(F.when(any_act, put(F.lit(1), counted & _side(side))).cast("long").alias(f"ActionCounts_{side}"))
        out += [F.when(any_act, put(F.lit(1), counted & _side(side) & (F.col("Name") == a))).cast("long").alias(f"{a}_Act_{side}") for a in actions]
    out.append(F.when(any_act, put(F.lit(1), counted)).cast("long").alias("TotalActions"))
    return out


def collision_columns(hits: Column) -> list[Column]:
    """Aggregates: collisions that began (state 0), by the side that struck, and ties."""
    begun = hits & (F.col("State").try_cast("int") == 0)
    tie = F.coalesce(F.col("ColTieBreaker"), F.lit(0))
    struck = begun & (tie == 0) & (F.col("ColActor") == 1)
    return [
        F.count_if(struck & _side("L")).alias("Collisions_L"),
        F.count_if(struck & _side("R")).alias("Collisions_R"),
        F.coalesce(F.sum(F.when(begun, tie)), F.lit(0)).cast("long").alias("Collisions_Tie"),
    ]


#: The event columns that metrics are made of.
MEASURED = ("GameIndex", "GameWinner", "StartedAt", "UpdatedAt", "Actor", "Category", "State", "Name", "ColActor", "ColTieBreaker")


def measured(events: DataFrame, dimensions: Sequence[str] = ()) -> DataFrame:
    """The columns of events that game_metrics reads, which it does in some passes: to be written once where reading them is dear."""
    return events.select(*[c for c in dict.fromkeys(["source_file", *MEASURED, "round_pos", "event_pos", *dimensions]) if c in events.columns])


def game_metrics(events: DataFrame, keys: Sequence[str] = KEYS, dimensions: Sequence[str] = (), actions: Sequence[str] = tuple(ACTIONS), most: int | None = MOST) -> DataFrame:
    """One row a game: winner, duration, durations and counts of actions, collisions; dimensions are constant in a game.

    Events are dealt by game, those of games of over `most` events by ranges of time too; tasks then send one row for each
    game that they have a part of. Without `most`, events are dealt by game once, for all.
    """
    keys = [k for k in keys if k in events.columns]
    rows = with_actual_duration(events, keys, most=most)
    acts, hits = F.coalesce(F.col("Category") == "Action", F.lit(False)), F.coalesce(F.col("Category") == "Collision", F.lit(False))
    return rows.groupBy(*keys).agg(
        F.max("GameWinner").alias("Winner"), F.max("UpdatedAt").alias("MatchDur"), *action_columns(acts, actions), *collision_columns(hits),
        *[F.max(c).alias(c) for c in dimensions],
    )
