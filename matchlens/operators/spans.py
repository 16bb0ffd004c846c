"""Games of any size: extents by two-level sums, and ranges of time inside a game that is too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A game with more events is dealt to ranges of about so many, each of which one task can hold.
MOST = 1_000_000
#: A large game's events are counted in at most so many equal parts of its time, to find ranges of like size.
PARTS = 4096


def same(a: Sequence[str], b: Sequence[str]) -> Column:
    """Equal keys, null being a key too."""
    here = F.lit(True)
    for x, y in zip(a, b):
        here = here & F.col(x).eqNullSafe(F.col(y))
    return here


def with_group(df: DataFrame, keys: Sequence[str], *values: Column) -> DataFrame:
    """df with aggregates of each row's group. Tasks send a row for each group that they have; a hot group's rows stay spread."""
    own = [f"_k{i}" for i in range(len(keys))]
    groups = df.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)]).agg(*values)
    return df.join(groups, same(keys, own)).drop(*own)


def sliced(df: DataFrame, keys: Sequence[str], t: str = "UpdatedAt", most: int = MOST, name: str = "_slice") -> DataFrame:
    """Adds the range of time that a row of a large game is in, from 0 and growing with time; null in all other games.

    A game's time is cut into equal parts, eight for each range that it needs, up to PARTS; ranges are runs of parts with
    about `most` rows. Rows of one instant are in one range. Rows without a time are in the first. What is sent to the rows
    has a row for each large game and for each of its parts that has rows: up to 17 for each `most` of all rows.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    grouped = df.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)])
    parts = F.least(F.ceil(F.col("_n") / most) * 8, F.lit(PARTS)).cast("int")
    large = grouped.agg(F.count("*").alias("_n"), F.min(t).alias("_lo"), F.max(t).alias("_hi")).where(F.col("_n") > most).withColumn("_parts", parts)
    share = F.try_divide(F.col(t) / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
    part = F.when(share.isNull(), 0).otherwise(F.least(F.floor(share * F.col("_parts")), F.col("_parts") - 1)).cast("int")
    # The hints: where a table is small as stored, estimates take all rows for less than the few large games; and what is
    # joined by game otherwise sorts a large game in one task.
    counts = df.select(*keys, t).join(F.broadcast(large), same(keys, own)).groupBy(*own, part.alias("_part")).agg(F.count("*").alias("_in"))
    before = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # of parts
    of = [f"_o{i}" for i in range(len(keys))]
    ranges = counts.select(*[F.col(o).alias(x) for o, x in zip(own, of)], F.col("_part").alias("_of"), F.floor(F.coalesce(F.sum("_in").over(before), F.lit(0)) / most).cast("int").alias(name))
    rows = df.join(F.broadcast(large.drop("_n")), same(keys, own), "left").withColumn("_part", F.when(F.col("_parts").isNotNull(), part))
    return rows.join(F.broadcast(ranges), same([*own, "_part"], [*of, "_of"]), "left").drop(*own, *of, "_of", "_part", "_lo", "_hi", "_parts")
