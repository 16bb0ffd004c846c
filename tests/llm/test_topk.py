import math
import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from matchlens.llm import topk

LONG = (1 << 63) - 1


def slow(rows, k=5, every=50):
    whole = []
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v):
            whole.append((n, i, [math.floor(256 * x) for x in v]))
    out = []
    for n, q, a in whole:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, v)), i) for m, i, v in whole if m != n)[:k]
            out += [(q, r + 1, i, max(-LONG - 1, min(LONG, -s))) for r, (s, i) in enumerate(best)]
    return sorted(out)


def listed(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


f32 = lambda x: float(np.float32(x))


def test_against_brute_force(spark):
    """Ties, repeated rows and ids, nulls, non-finite, short and empty vectors, clashing columns; any block sizes."""
    rng = random.Random(5)
    rows = [(i, [f32(rng.gauss(0, 1)) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(40)] + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (2250, [1.0]), (None, [1.0] * 8)]
    rows += [(50, [f32(-9)] * 8), (50, rows[50][1]), (1, [3.0] * 8), (1, [3.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("far", F.lit(2)).withColumn("uid", F.lit("x"))
    for block, query_block in ((4096, 8192), (37, 3)):
        assert listed(topk.top_k(vectors, block=block, query_block=query_block, n_pivots=6)) == slow(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1, -1]) * rng.random() * 10 ** rng.choice([0, 3, 6, 9, 15]) for _ in range(5)]) for i in range(120)]
    rows += [(150, [1e200, 1.0, 0.0, 0.0, 0.0]), (151, [1e307] * 5), (152, [-1e250, 2.0, 3.0, 1e30, 0.0]), (200, [16384.0] * 5)]
    assert listed(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=40, n_pivots=4)) == slow(rows)


def test_sql_agrees_on_repeated_ids(spark):
    rng = random.Random(7)
    rows = [(rng.choice([0, 1, 2, 50, 51, 100]), [f32(rng.gauss(0, 1)) for _ in range(4)]) for _ in range(40)] + [(1, [2.0] * 4)] * 2 + [(50, None)]
    con = duckdb.connect()
    con.register("frame", pd.DataFrame({"vec_id": [i for i, _ in rows], "embedding": [v for _, v in rows]}))
    con.execute("create view embeddings as select vec_id::bigint as vec_id, embedding::float[] as embedding from frame")
    assert listed(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == sorted(con.execute(topk.ORACLE_SQL).fetchall())


def test_groups_are_eliminated_before_the_shuffle(spark):
    """In clusters, most pairs never reach a task, and few of those that do are evaluated."""
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 4, (12, 16))
    rows = [(i, (centers[i % 12] + rng.normal(0, 0.05, 16)).tolist()) for i in range(3000)]
    found, seen = topk.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=128, n_pivots=12)
    assert listed(found) == slow(rows)
    assert seen["shipped"].value < 0.5 * 60 * 3000 and seen["evaluated"].value < 0.2 * 60 * 3000


def test_pivots_eliminate_without_clusters():
    """Also where all vectors are about equally far from each other."""
    rng = np.random.default_rng(3)
    block = rng.normal(0, 1, (3000, 32))
    block = np.floor(256 * block / np.linalg.norm(block, axis=1)[:, None])
    ids, pivots = np.arange(3000), topk.choose_pivots(block, 24)
    place = topk.placed(topk.distances(block, pivots), pivots, topk.span_of(pivots))
    found, seen = topk.search_block(block[:10], ids[:10], np.full(10, -np.inf), place[:10], block, ids, ids, place, 5)
    assert seen["evaluated"] < 0.1 * seen["pairs"]
    for i in range(10):
        scores = sorted((-int(block[i] @ block[j]), j) for j in range(3000) if j != i)[:5]
        assert [(j, -s) for s, j in scores] == [(v, s) for qi, v, s in found if qi == i]


def test_empty_and_single(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0
