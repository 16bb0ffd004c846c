"""Histograms, densities, correlation and regression as DataFrame operations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quantiles

def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, median and population deviation. The median is exact, by quantiles.exact; a group without values has none."""
    rows = quantiles.kept(df, value, by)
    out = rows.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return _with_groups(out, quantiles.exact(rows, "v", {"median": 0.5}, by), by, "left").select(*by, "n", "mean", "median", "std")


def _bounds(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """lo and hi of each group, half a unit wider on both sides where they are equal, and n."""
    out = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).where("n > 0")
    wide = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    return out.withColumns({"lo": F.col("lo") - wide, "hi": F.col("hi") + wide})


def _with_groups(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """df with its groups' row. Without keys that is one row, so its size is bounded."""
    if by:
        renamed, here = groups.withColumnsRenamed({k: f"_{k}" for k in by}), F.lit(True)
        for k in by:
            here = here & F.col(k).eqNullSafe(F.col(f"_{k}"))  # null is a group too
        return df.join(renamed, here, how).drop(*[f"_{k}" for k in by])
    one = groups.select(F.lit(1).alias("_one"), "*")
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one", how).drop("_one")


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = (), shared: bool = False) -> DataFrame:
    """by, bin, start, stop, count, density: equal bins from the least to the greatest value, the last closed.

    Bins without values have no row. With `shared` all groups have the edges of the whole.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    keys = () if shared else by
    edges = _bounds(rows, "v", keys)
    joined = _with_groups(rows, edges.select(*keys, "lo", "hi"), keys)
    k = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    out = joined.select(*by, "lo", "hi", k.alias("bin")).groupBy(*by, "bin", "lo", "hi").agg(F.count("*").alias("count"))
    totals = rows.groupBy(*by).agg(F.count("*").alias("_total"))
    width = (F.col("hi") - F.col("lo")) / bins
    out = _with_groups(out, totals, by).withColumns({"start": F.col("lo") + F.col("bin") * width, "stop": F.col("lo") + (F.col("bin") + 1) * width})
    return out.withColumn("density", F.col("count") / (F.col("_total") * width)).select(*by, "bin", "start", "stop", "count", "density")


def histogram2d(df: DataFrame, x: str, y: str, tile: float, by: Sequence[str] = ()) -> DataFrame:
    """by, ix, iy, count over square tiles from the least x and y on; the last edge is closed."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    low = rows.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    joined = _with_groups(rows, low, by)

    def index(c: str) -> Column:
        span = F.col(f"{c}_hi") - F.col(f"{c}_lo")
        return F.least(F.floor((F.col(c) - F.col(f"{c}_lo")) / tile), F.greatest(F.ceil(span / tile) - 1, F.lit(0))).cast("int")

    return joined.select(*by, index("x").alias("ix"), index("y").alias("iy")).groupBy(*by, "ix", "iy").agg(F.count("*").alias("count"))


#: A kernel counts where it is at least this share of its peak: the density left out at a place is at most this share of one kernel's peak, divided by the kernels' mean width.
TAIL = 1e-12


def _steps(low: Column, high: Column, most: int) -> Column:
    """One row for each whole number from low to high, within 0 to most; none if there are none."""
    first, last = F.greatest(F.ceil(low), F.lit(0)).cast("int"), F.least(F.floor(high), F.lit(most)).cast("int")
    return F.explode(F.when(first <= last, F.sequence(first, last)))


def kde1d(df: DataFrame, value: str, points: int = 200, by: Sequence[str] = (), tail: float = TAIL) -> DataFrame:
    """by, i, x, density: a Gaussian kernel density at equal steps from the least to the greatest value (Scott's width h).

    A value meets only the steps at which its kernel is above `tail` of its peak, within h * sqrt(-2 ln tail), so that a
    density is low by at most tail / (h sqrt(2 pi)). Sums are made in the tasks that read the values; only sums are
    shuffled. Nulls don't count; groups of one value, or of equal ones, give no rows.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    groups = rows.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n")).where("n > 1 and sd > 0")
    groups = groups.select(*by, "lo", "hi", "n", (F.col("sd") * F.pow(F.col("n").cast("double"), -0.2)).alias("h"))
    last = max(points - 1, 1)
    step, reach = (F.col("hi") - F.col("lo")) / last, F.col("h") * math.sqrt(-2 * math.log(tail))
    at = lambda i: F.col("lo") + i / F.lit(float(last)) * (F.col("hi") - F.col("lo"))
    place = lambda v: (v - F.col("lo")) / step
    near = _with_groups(rows, groups, by).select("*", _steps(place(F.col("v") - reach), place(F.col("v") + reach), points - 1).alias("i"))
    kernel = F.exp(-0.5 * F.pow((at(F.col("i")) - F.col("v")) / F.col("h"), F.lit(2.0)))
    sums = near.groupBy(*by, "i").agg(F.sum(kernel).alias("_sum"))
    grid = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    out = _joined(grid, sums, [*by, "i"])
    return out.select(*by, "i", at(F.col("i")).alias("x"), (F.coalesce("_sum", F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def kde2d(df: DataFrame, x: str, y: str, half_width: float, cells: int = 100, by: Sequence[str] = (), tail: float = TAIL) -> DataFrame:
    """by, ix, iy, x, y, density on a square grid around the origin: Gaussian kernels, full covariance, Scott's factor.

    A point meets only the cells of the ellipse in which its kernel is above `tail` of its peak: first the columns that
    the ellipse reaches, in each of them the rows between its borders. So a density is low by at most tail / (2 pi
    sqrt(det)) of the kernels' covariance. The more points, the narrower the kernels and the fewer the cells. Sums are
    made in the tasks that read the points; only sums are shuffled. Points with a null don't count; groups of one point, or
    on a line, give no rows.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.var_samp("px").alias("sxx"), F.var_samp("py").alias("syy"), F.covar_samp("px", "py").alias("sxy")).where("n > 1 and sxx * syy - sxy * sxy > 1e-12")
    groups = groups.withColumn("f", F.pow(F.col("n").cast("double"), -1.0 / 3))  # the factor n^(-1/6), squared
    groups = groups.withColumn("det", (F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")) * F.col("f") * F.col("f"))
    groups = groups.select(*by, "n", "det", *[(F.col(v) * F.col("f")).alias(k) for k, v in (("vx", "sxx"), ("vy", "syy"), ("vxy", "sxy"))])
    step, square = 2 * half_width / (cells - 1), -2 * math.log(tail)
    at = lambda i: F.lit(-half_width) + i * F.lit(step)
    place = lambda v: (v + half_width) / step
    wide = F.sqrt(F.col("vx") * square)
    near = _with_groups(rows, groups, by).select("*", _steps(place(F.col("px") - wide), place(F.col("px") + wide), cells - 1).alias("ix"))
    near = near.withColumn("dx", at(F.col("ix")) - F.col("px"))
    # In a column the kernel is widest at py + vxy / vx * dx, and reaches as far as is left of the ellipse there.
    middle = F.col("py") + F.col("vxy") / F.col("vx") * F.col("dx")
    tall = F.sqrt(F.greatest(F.col("det") / F.col("vx") * (square - F.col("dx") * F.col("dx") / F.col("vx")), F.lit(0.0)))
    near = near.select("*", _steps(place(middle - tall), place(middle + tall), cells - 1).alias("iy")).withColumn("dy", at(F.col("iy")) - F.col("py"))
    form = (F.col("vy") * F.col("dx") * F.col("dx") - 2 * F.col("vxy") * F.col("dx") * F.col("dy") + F.col("vx") * F.col("dy") * F.col("dy")) / F.col("det")
    sums = near.groupBy(*by, "ix", "iy").agg(F.sum(F.exp(-0.5 * form)).alias("_sum"))
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    grid = groups.select("*", every.alias("ix")).select("*", every.alias("iy"))
    out = _joined(grid, sums, [*by, "ix", "iy"])
    density = F.coalesce("_sum", F.lit(0.0)) / (F.col("n") * 2 * math.pi * F.sqrt("det"))
    return out.select(*by, "ix", "iy", at(F.col("ix")).alias("x"), at(F.col("iy")).alias("y"), density.alias("density"))


def _joined(grid: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of grid with the sums that its places have; keys may be null."""
    renamed = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], "_sum")
    here = F.lit(True)
    for k in keys:
        here = here & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return grid.join(renamed, here, "left")


def masked_density(grid: DataFrame, quantile: float = 0.4, by: Sequence[str] = ()) -> DataFrame:
    """density is null where it lies below the quantile of its grid."""
    limits = grid.groupBy(*by).agg(F.percentile("density", quantile).alias("_limit"))  # of a grid's cells, so many at most
    return _with_groups(grid, limits, by).withColumn("density", F.when(F.col("density") >= F.col("_limit"), F.col("density"))).drop("_limit")


def pearson(x: str, y: str) -> Column:
    """Correlation of rows in which neither is null; null where one is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def line(x: str, y: str) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line; null where x is constant."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return F.regr_slope(b, a), F.regr_intercept(b, a)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return out


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(r: float, n: float) -> float:
    """The chance of a correlation at least as far from 0, of n unrelated normal pairs."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    freedom = n - 2
    return _beta(freedom / 2, 0.5, freedom / (freedom + r * r * freedom / (1 - r * r)))


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([two_sided_p(a, b) for a, b in zip(r, n)])
