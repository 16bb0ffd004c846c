"""Exact quantiles of any number of values, without sorting them and without a group's values in one task.

Each wanted rank is looked for in a range of values, at first the whole of its group. A pass counts the values in equal
bins of the range, keeps the bin that holds the rank, and takes the least and greatest value in it as the next range. Bins
are monotone in the value, so counts before a bin are counts of smaller values whatever rounding does. A range with few
values left is settled by sorting those; one of equal values is settled as it is, ties in any number included.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written

#: Bins of a pass, and how many values a range may have to be sorted.
BINS, SORTED = 1024, 10_000
#: A pass narrows a range 1,024-fold at least, and doubles lie within 2^2,098 of each other.
PASSES = 256


def kept(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by and the value as v, written once and read again: passes read it, not what it was made from. Nulls and NaN are null."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return written(df.select(*by, v.alias("v")), shared_folder(df.sparkSession))


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    here = F.lit(True)
    for x, y in zip(a, b):
        here = here & F.col(x).eqNullSafe(F.col(y))
    return here


def exact(df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = (), bins: int = BINS, most: int = SORTED) -> DataFrame:
    """by, and for each name in shares the quantile of that share (0 to 1), between the two next values where it lies between.

    Nulls don't count; groups without values give no row. Infinite values are as good as others. df is read in each pass:
    see kept().
    """
    spark, own = df.sparkSession, [f"_g{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(o) for k, o in zip(by, own)], F.col(value).alias("_v"))
    groups = rows.groupBy(*own).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    place = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_rank")) for name, p in shares.items() for rank in (F.floor(place(p)), F.ceil(place(p)))])
    groups = written(groups, shared_folder(spark))
    # Ranks wanted of one group, each once, with the range that holds it and how many values lie below that.
    ranges = groups.select(*own, F.explode(F.array_distinct(F.transform(wanted, lambda w: w["_rank"]))).alias("_rank"), F.col("_n").alias("_in"), F.lit(0).cast("long").alias("_below"), "_lo", "_hi")
    done, names = None, [f"_r{c}" for c in ("in", "below", "lo", "hi", "rank")]
    for _ in range(PASSES):
        ranges = written(ranges, shared_folder(spark))
        open_ = ranges.where((F.col("_in") > most) & (F.col("_lo") < F.col("_hi")))
        settled = ranges.where((F.col("_in") <= most) | (F.col("_lo") >= F.col("_hi")))
        done = settled if done is None else done.unionByName(settled)
        if open_.isEmpty():
            break
        same = [f"{o}_" for o in own]
        asked = open_.select(*[F.col(o).alias(s) for o, s in zip(own, same)], *[F.col(f"_{n[2:]}").alias(n) for n in names])
        met = rows.join(asked, _same(own, same) & (F.col("_v") >= F.col("_rlo")) & (F.col("_v") <= F.col("_rhi")))
        # Halved first, so that a range over all doubles doesn't overflow.
        low, high = F.greatest("_rlo", F.lit(-1.7976931348623157e308)), F.least("_rhi", F.lit(1.7976931348623157e308))
        share = (F.col("_v") / 2 - low / 2) / (high / 2 - low / 2)
        bin_ = F.when(F.col("_v") <= low, 0).when(F.col("_v") >= high, bins + 1).otherwise(F.least(F.floor(share * bins) + 1, F.lit(bins)))
        counts = met.groupBy(*own, "_rrank", "_rbelow", bin_.cast("int").alias("_bin")).agg(F.count("*").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = Window.partitionBy(*own, "_rrank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # of bins, so many at most
        counts = counts.withColumn("_below", F.col("_rbelow") + F.coalesce(F.sum("_in").over(before), F.lit(0)))
        here = (F.col("_rrank") >= F.col("_below")) & (F.col("_rrank") < F.col("_below") + F.col("_in"))
        ranges = counts.where(here).select(*own, F.col("_rrank").alias("_rank"), "_in", "_below", "_lo", "_hi")
    else:
        raise RuntimeError("ranges didn't close")
    flat = done.where("_lo >= _hi").select(*own, "_rank", F.col("_lo").alias("_found"))
    same = [f"{o}_" for o in own]
    few = done.where("_lo < _hi").select(*[F.col(o).alias(s) for o, s in zip(own, same)], F.col("_rank"), "_below", "_lo", "_hi")
    inside = rows.join(few, _same(own, same) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    order = Window.partitionBy(*own, "_rank").orderBy("_v")  # of few values
    sorted_ = inside.withColumn("_k", F.row_number().over(order) - 1 + F.col("_below")).where("_k = _rank").select(*own, "_rank", F.col("_v").alias("_found"))
    found = flat.unionByName(sorted_).groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_found"))).alias("_of"))
    found = found.select(*[F.col(o).alias(s) for o, s in zip(own, same)], "_of")
    out = groups.join(found, _same(own, same)) if own else groups.join(F.broadcast(found))

    def between(p: float) -> Column:
        low, high = F.col("_of")[F.floor(place(p)).cast("long")], F.col("_of")[F.ceil(place(p)).cast("long")]
        return F.when(low == high, low).otherwise(low + (high - low) * (place(p) - F.floor(place(p))))

    return out.select(*[F.col(o).alias(k) for k, o in zip(by, own)], *[between(p).alias(name) for name, p in shares.items()])
