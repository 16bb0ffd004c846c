"""Connected components by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds, unpartitioned


def _onto_least(edges: DataFrame, key: str, least: DataFrame, out: list) -> DataFrame:
    return edges.join(least.select(unpartitioned("k"), "m"), edges[key] == F.col("k"), "left").select(*out)


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each higher neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("m")).where("m < k")
    linked = _onto_least(edges, "lo", least, ["hi", F.coalesce("m", "lo").alias("lo")])
    return linked.where("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its lower neighbours to the least of them."""
    least = edges.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("m"))
    joined = _onto_least(edges, "hi", least, ["hi", "lo", "m"])
    pairs = F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return joined.select(F.inline(pairs)).where("hi <> lo").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link to another; root is the least node of its component.

    Rounds end when the links stop changing. Nulls and loops are no links; no links give an empty result.
    Only a count and a checksum of a round's links reach the driver. Raises if max_rounds don't suffice.
    """
    edges = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    rounds, before = Rounds(edges.sparkSession), None
    edges = rounds.written(edges)
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select(F.col("lo"), F.col("lo")).distinct())
        before = now
        if not now[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        edges = rounds.written(_small_star(_large_star(edges)))
    raise RuntimeError(f"components still change after {max_rounds} rounds")
