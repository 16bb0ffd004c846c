import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchlens.llm import jaccard


def shingles(text):
    found = (text or "").lower().split()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def slow_components(rows):
    root, sets = {i: i for i, _ in rows}, {i: shingles(t) for i, t in rows}
    for a in root:
        for b in root:
            shared = len(sets[a] & sets[b])
            if a < b and root[a] != root[b] and 10 * shared >= 8 * (len(sets[a]) + len(sets[b]) - shared):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    return root


@pytest.fixture(scope="module")
def rows():
    """Texts with one to six words changed, at similarities about the limit, chains, short texts and texts without words."""
    rng, out = random.Random(3), [None, "", " \n", "one", "One", "one two", "a b c d e", "a b c d e f"]
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 150, 300]))]
        for _ in range(8):
            new = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 50)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(5000)}"
            out.append(" ".join(new))
            if g % 2:
                base = new
    return list(enumerate(out))


def test_crowded_buckets_give_the_same_components(spark, rows):
    """Buckets of any size count as crowded; what two pivots leave apart is found by rare shingles."""
    rows = rows[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("root", F.lit("x"))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, dense=1).collect()}
    assert got == slow_components(rows)


def test_stage_keeps_one_row_of_each_component(spark, rows):
    assert len(set(slow_components(rows).values())) < len(rows) - 40
    docs = spark.createDataFrame([*rows, rows[20], (None, rows[20][1])], "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=lambda x: (x is None, x)) == [*sorted(set(slow_components(rows).values())), None]
