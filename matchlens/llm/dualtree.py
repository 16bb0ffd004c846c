"""Lloyd clustering with a cover tree over vectors and one over centroids.

Vectors stay in the partition where they are read, in blocks, each with a cover tree that is built once. In each round a
tree over the centroids goes to all tasks, which meet it with their blocks' trees; sums by centroid are all that is
shuffled, and all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, table
from .covertree import CoverTree, cover_tree, nearest
from .topk import encoded, matrix
from .vectors import cleaned, squared_pairs, sums_by

SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
MOST = (1 << 63) - 1


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, scale: float = 256.0, block: int = 2048, leaf: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each row that takes part.

    Rows whose vector is null, has another number of components than `dims`, or holds null or non-finite ones, take no
    part. Components become floor(scale * x), cut at 2^26 in size. The first centroids are the vectors with the smallest
    sha256 of "<seed>:<id>"; rows with one id go by the bytes of their vector, rows without an id come last. With fewer
    than k rows there are so few centroids. Equally near ones: the smaller number. An empty cluster stays where it is.
    Repeated rows are rows of their own. Sums of distances beyond a long are the largest long. Other columns, whatever
    their names, play no part. An empty table gives no rows.
    """
    return clustered(vectors, k, rounds, dims, seed, scale, block, leaf, id_col, vector_col)[0]


def clustered(vectors: DataFrame, k: int, rounds: int, dims: int, seed: int, scale: float, block: int, leaf: int, id_col: str, vector_col: str) -> tuple[DataFrame, list]:
    """What clusters returns, and a counter of the distances computed in each assignment, filled as it runs."""
    spark = vectors.sparkSession
    store = Rounds(spark)
    rows = cleaned(vectors, dims, scale, id_col, vector_col)

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block: ids, vectors and the tree over them."""
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = matrix(part.column(1).to_pylist(), dims)
                order, whole, radius = cover_tree(x, leaf).encoded()
                columns = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), *[pa.array([b], pa.binary()) for b in (encoded(x.ravel()), order, whole, radius)]]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "v", "tree_order", "nodes", "radius"])

    blocks = store.written(rows.mapInArrow(planted, "ids array<long>, v binary, tree_order binary, nodes binary, radius binary"))
    first = rows.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], SCHEMA), []
    centroids, counters = matrix([r["v"] for r in first], dims), []

    def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, counter) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        over = cover_tree(centroids, 1)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                x = matrix([batch.column(1)[i].as_py()], len(ids) * dims).reshape(-1, dims)
                found, computed = nearest(x, CoverTree.decoded(*[batch.column(c)[i].as_py() for c in (2, 3, 4)]), centroids, over)
                counter.add(computed)
                yield ids, x, found

    def sums(centroids: np.ndarray, counter):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
            for _, x, found in assigned(batches, centroids, counter):
                which, count, added = sums_by(x, found)
                n[which] += count
                total[which] += added
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["k", "n", "s"])

        return run

    for _ in range(rounds):
        counters.append(spark.sparkContext.accumulator(0))
        found = blocks.mapInArrow(sums(centroids, counters[-1]), "k int, n long, s array<long>")
        found = found.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", i)).alias(f"s{i}") for i in range(dims)])
        moved = centroids.copy()
        for r in found.collect():  # at most k rows
            moved[r["k"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        centroids = moved

    counters.append(spark.sparkContext.accumulator(0))

    def last(centroids: np.ndarray, counter):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x, found in assigned(batches, centroids, counter):
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int32()), pa.array(squared_pairs(x, centroids[found]), pa.int64())], ["vec_id", "cluster", "distance"])

        return run

    placed = store.written(blocks.mapInArrow(last(centroids, counters[-1]), "vec_id long, cluster int, distance long"))
    by_cluster = dict(placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect())  # at most k rows
    each = [min(int(by_cluster.get(i, 0)), MOST) for i in range(len(centroids))]
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    total = min(sum(int(d) for d in by_cluster.values()), MOST)
    return placed.select("vec_id", "cluster", "distance", of(each).cast("long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), of(digests).alias("centroid_sha256")), counters


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql(dims: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """The same by meeting all centroids each time."""
    steps = [
        f"""kept as materialized (select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as materialized (select n - 1 as k, v as c from (select v, row_number() over (order by sha256('{seed}:' || vec_id) nulls last) as n from kept) where n <= {k})",
    ]
    for i in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        steps.append(f"a{i} as materialized (select uid, any_value(vec_id) as vec_id, any_value(v) as v, min({apart} * 64 + k) as m from kept, c{i} group by uid)")
        if i < rounds:
            sums = f"select k, d, (s - ((s % n) + n) % n) // n as x from (select m % 64 as k, d, count(*) as n, sum(v[d])::bigint as s from a{i}, range(1, {dims + 1}) r(d) group by 1, 2)"
            steps.append(f"c{i + 1} as materialized (select k, coalesce(t.c, c{i}.c) as c from c{i} left join (select k, list(x order by d) as c from ({sums}) group by k) t using (k))")
    last = f"a{rounds}"
    return "with " + ",\n".join(steps) + f"""
select vec_id, k::integer as cluster, d as distance, sum(d) over (partition by k)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
  from (select vec_id, m % 64 as k, m // 64 as d from {last}) join c{rounds} using (k)"""


ORACLE_SQL = _sql()
