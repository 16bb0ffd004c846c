"""Codes by Yinyang Lloyd and clusters by dual trees, against plain Lloyd rounds."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchlens.llm import covertree, dualtree, yinyang
from matchlens.llm.vectors import LARGEST, squared

WRONG = [(900, None), (901, [None] * 8), (902, [float("nan")] + [1.0] * 7), (903, [math.inf] * 8), (904, []), (905, [1.0] * 7)]


def whole(rows, dims=8):
    """(id, label, integers) of the rows that take part."""
    cut = lambda x: int(min(max(math.floor(min(256 * x, 1e300)), -LARGEST), LARGEST))
    return [(i, lab, [cut(x) for x in v]) for i, v, lab in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


def lloyd(points, centers, rounds):
    """Assignments and centers of plain Lloyd rounds in Python's own integers."""
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c)), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        at = [near(p)[1] for p in points]
        centers = [[sum(c) // len(mine) for c in zip(*mine)] if (mine := [p for p, a in zip(points, at) if a == k]) else centers[k] for k in range(len(centers))]
    return [near(p) for p in points], centers


def digest(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def slow_codes(rows, parts=4, entries=6, rounds=2, dims=8):
    kept = whole(rows, dims)
    first = sorted(kept, key=lambda r: (r[0] is None, r[0]))[:entries]
    w = dims // parts
    each = [lloyd([v[p * w : p * w + w] for _, _, v in kept], [v[p * w : p * w + w] for _, _, v in first], rounds) for p in range(parts)]
    name = digest([x for _, centers in each for c in centers for x in c])
    errors, total = [sum(found[n][0] for found, _ in each) for n in range(len(kept))], {}
    for (_, lab, _), e in zip(kept, errors):
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, "".join(f"{found[n][1]:02x}" for found, _ in each), errors[n], total[lab], name) for n, (i, lab, _) in enumerate(kept)), key=repr)


def slow_clusters(rows, k=5, rounds=5, dims=8):
    kept = whole(rows, dims)
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())[:k]
    found, centers = lloyd([v for _, _, v in kept], [v for _, _, v in first], rounds)
    each = [sum(d for d, a in found if a == c) for c in range(len(centers))]
    return sorted(((i, a, d, each[a], sum(each), digest(centers[a])) for (i, _, _), (d, a) in zip(kept, found)), key=repr)


def data(seed, n=300, clusters=7, spread=0.1):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(clusters)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in centers[i % clusters]], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(n + i, [0.0, 0.5] * 4, 0) for i in range(60)] + [(n + 60 + i, [round(rng.random() * 3) / 256 for _ in range(8)], 1) for i in range(60)]
    return rows + [(i, v, 1) for i, v in WRONG] + [(None, [0.25] * 8, None)] * 2 + [rows[4], rows[4]]


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"v": F.lit(1), "code": F.lit("x"), "keep_0": F.lit(2), "n": F.lit(3)}).repartition(3)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_against_plain_lloyd(spark, seed):
    """Clusters, copies, ties, nulls, wrong lengths, repeated rows, clashing columns."""
    got = collected(yinyang.compress(frame(spark, data(seed)), dims=8, parts=4, entries=6, groups=3))
    assert got == slow_codes(data(seed))


@pytest.mark.parametrize("seed,leaf", [(1, 4), (2, 32)])
def test_clusters_against_plain_lloyd(spark, seed, leaf):
    got = collected(dualtree.clusters(frame(spark, data(seed)), k=5, dims=8, block=100, leaf=leaf))
    assert got == slow_clusters(data(seed))


def test_large_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1, -1]) * rng.random() * 10 ** rng.choice([0, 3, 5]) for _ in range(8)], 0) for i in range(80)] + [(90, [1e200] * 8, 0), (91, [-1e300] * 8, 1), (92, [1.7e308] + [0.0] * 7, 1)]
    assert collected(yinyang.compress(frame(spark, rows), dims=8, parts=4, entries=6, groups=3)) == slow_codes(rows)
    assert collected(dualtree.clusters(frame(spark, rows), k=5, dims=8)) == slow_clusters(rows)


def test_few_rows_and_none(spark):
    rows = [(3, [1.0] * 8, None), (5, [1.0] * 8, 2)]
    assert collected(yinyang.compress(frame(spark, rows), dims=8, parts=4, entries=6)) == slow_codes(rows)
    assert collected(dualtree.clusters(frame(spark, rows), k=5, dims=8)) == slow_clusters(rows)
    nothing = frame(spark, rows).limit(0)
    for out, schema in ((yinyang.compress(nothing, dims=8, parts=4), yinyang.SCHEMA), (dualtree.clusters(nothing, dims=8), dualtree.SCHEMA)):
        assert out.count() == 0 and ", ".join(f"{c} {t}".replace("bigint", "long") for c, t in out.dtypes) == schema


@pytest.mark.parametrize("module,dims", [(yinyang, 64), (dualtree, 64)])
def test_sql_agrees(spark, module, dims):
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.gauss(0, 1) / 8)) for _ in range(dims)], rng.choice([0, 1, None])) for i in range(130)] + [(200, None, 1), (201, [None] * dims, 1)]
    con = duckdb.connect()
    con.register("frame", pd.DataFrame({"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows], "label": pd.array([r[2] for r in rows], dtype="Int32")}))
    con.execute("create view embeddings as select vec_id::bigint as vec_id, embedding::float[] as embedding, label from frame")
    run = yinyang.compress if module is yinyang else dualtree.clusters
    assert collected(run(frame(spark, rows, "float"))) == sorted(con.execute(module.ORACLE_SQL).fetchall(), key=repr)


def test_bounds_leave_most_distances_out(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 4, (12, 8))
    rows = [(i, (centers[i % 12] + rng.normal(0, 0.05, 8)).tolist(), 0) for i in range(2400)]
    out, counters = yinyang.compressed(frame(spark, rows), 8, 4, 24, 2, 8, 256.0, "vec_id", "embedding", "label")
    out.collect()
    first, *later = [c.value for c in counters]
    assert first == 2400 * 4 * 24 and max(later) < 0.4 * first
    out, counters = dualtree.clustered(frame(spark, rows), 24, 5, 8, 2, 256.0, 2048, 32, "vec_id", "embedding")
    out.collect()
    assert max(c.value for c in counters) < 0.25 * 2400 * 24


def test_yinyang_scans_keep_true_bounds():
    """Whatever the entries do, codes are the nearest, and bounds hold."""
    rng = np.random.default_rng(4)
    for case in range(20):
        x = np.floor(rng.normal(0, 40, (500, 3)))
        entries = np.floor(rng.normal(0, 40, (20, 3)))
        entries[7] = entries[3]
        group = yinyang.grouped(entries, 5)
        code, high, low = yinyang.first_scan(x, entries, group)
        for _ in range(3):
            moved = entries + np.floor(rng.normal(0, case, entries.shape)) * (rng.random((20, 1)) < 0.5)
            drift = np.sqrt(((moved - entries) ** 2).sum(axis=1))
            code, high, low, _ = yinyang.next_scan(x, moved, group, drift, code, yinyang.up(high).astype(float), yinyang.down(low).astype(float))
            entries = moved
            far = squared(x, entries)
            assert (code == far.argmin(axis=1)).all()
            own = far[np.arange(500), code].copy()
            assert (high**2 >= own - 1e-6).all()
            far[np.arange(500), code] = np.inf
            for g in range(group.max() + 1):
                assert (low[:, g] ** 2 <= far[:, group == g].min(axis=1) + 1e-6).all()


def test_cover_tree_is_one():
    """Every vector is in one leaf, within all radii above it; centers nest, and lie apart from their siblings."""
    rng = np.random.default_rng(5)
    for x in (np.floor(rng.normal(0, 50, (700, 2))), np.floor(rng.normal(0, 50, (300, 64))), np.zeros((200, 3)), np.floor(rng.normal(0, 1, (400, 2)) * 10 ** rng.uniform(0, 5, (400, 1)))):
        t = covertree.cover_tree(x, 8)
        assert sorted(t.order.tolist()) == list(range(len(x)))
        for i in range(len(t.low)):
            mine = t.order[t.low[i] : t.high[i]]
            assert t.center[i] in mine and covertree.distances(x[mine], x[t.center[i]]).max() <= t.radius[i] + 1e-9
            kids = range(t.child[i], t.last[i])
            if kids:
                apart = 2.0 ** (math.ceil(math.log2(t.radius[i])) - 1)
                assert t.center[kids[0]] == t.center[i] and sum(t.high[k] - t.low[k] for k in kids) == len(mine)
                assert all(t.radius[k] <= apart * (1 + 1e-9) for k in kids)
                between = np.sqrt(squared(x[t.center[list(kids)]], x[t.center[list(kids)]]))
                assert (between[~np.eye(len(kids), dtype=bool)] > apart).all()
        back = covertree.CoverTree.decoded(*t.encoded())
        assert (back.order == t.order).all() and (back.last == t.last).all() and (back.radius == t.radius).all()
