"""Places in one global order, without a window over all rows.

Equal values are counted first, so that ties in any number are one row, wherever ranges end. The different values are
dealt to ranges by approximate quantiles of theirs, whatever their distribution; each range counts its own, and the
counts of the ranges before it, at most RANGES numbers, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES, BLOCK = 1024, 32


def tied(df: DataFrame, value: Column, descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """_value, _before, _ties of each different value: how many rows come before it in the order, and how many have it. Nulls are left out."""
    counts = df.where(value.isNotNull()).groupBy(value.alias("_value")).agg(F.count("*").alias("_ties"))
    key = F.col("_value").cast("double")
    # Borders by a sketch that tasks merge; values beside a border may fall to either side, but equal keys to the same.
    borders = counts.agg(F.array_distinct(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], F.lit(20 * ranges))).alias("_borders"))
    return _counted(counts, key, borders, descending)


def _counted(counts: DataFrame, key: Column, borders: DataFrame, descending: bool) -> DataFrame:
    # A value is compared with every BLOCK-th border, then with those of one block.
    heads = F.filter("_borders", lambda b, i: i % BLOCK == 0).alias("_heads")
    borders = borders.select(F.coalesce("_borders", F.array().cast("array<double>")).alias("_borders")).select("_borders", heads)
    below = lambda array: F.size(F.filter(array, lambda b: b <= key))
    dealt = counts.join(F.broadcast(borders)).withColumn("_block", F.greatest(below(F.col("_heads")) - 1, F.lit(0)))
    dealt = dealt.withColumn("_range", F.col("_block") * BLOCK + below(F.slice("_borders", F.col("_block") * BLOCK + 1, BLOCK))).drop("_borders", "_heads", "_block")
    sums = dealt.groupBy(F.col("_range").alias("r")).agg(F.sum("_ties").alias("n"))  # at most RANGES rows
    # What comes before each range is summed once, not for each row.
    ahead = lambda r: lambda x: x["r"] > r["r"] if descending else x["r"] < r["r"]
    earlier = lambda r: F.aggregate(F.filter("_sums", ahead(r)), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    every = sums.agg(F.collect_list(F.struct("r", "n")).alias("_sums"))
    sums = every.select(F.inline(F.transform("_sums", lambda r: F.struct(r["r"].alias("_r"), earlier(r).alias("_earlier")))))
    order = Window.partitionBy("_range").orderBy(F.desc("_value") if descending else F.asc("_value")).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_ties").over(order), F.lit(0))
    return dealt.select("_range", "_value", inside.alias("_inside"), "_ties").join(F.broadcast(sums), F.col("_range") == F.col("_r")).select("_value", (F.col("_earlier") + F.col("_inside")).alias("_before"), "_ties")


def places(df: DataFrame, order: Column, name: str, ranges: int = RANGES) -> DataFrame:
    """df with each row's place, from 1, in the order of a struct whose first field is a number; no two rows are equal in it."""
    counts = df.select("*", order.alias("_value"), F.lit(1).cast("long").alias("_ties"))
    first = df.select(order.alias("_o")).select("_o.*").columns[0]
    key = F.coalesce(F.col("_value")[first].cast("double"), F.lit(float("-inf")))
    borders = counts.agg(F.array_distinct(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], F.lit(20 * ranges))).alias("_borders"))
    counted = _counted(counts.select("_value", "_ties"), key, borders, False)
    joined = counts.drop("_ties").join(counted.withColumnRenamed("_value", "_at"), F.col("_value") == F.col("_at"))
    return joined.withColumn(name, F.col("_before") + 1).drop("_value", "_at", "_before", "_ties")
