import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchlens.llm import suffixdedup, suffixes


def slow_repeated(parts, w):
    c = Counter(p[j : j + w] for p in parts for j in range(len(p) - w + 1))
    return [[c[p[j : j + w]] > 1 for j in range(len(p) - w + 1)] for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 97, 98, 255]), max_size=40).map(bytes), min_size=1, max_size=6), st.integers(1, 9))
def test_repeated_windows(parts, w):
    assert [f.tolist() for f in suffixes.repeated(parts, w)] == slow_repeated(parts, w)


def test_array_is_sorted():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"abc") for _ in range(60)) for _ in range(5)]
    joined, bases, order = suffixes.suffix_array(parts, [60] * 5, 60)
    suffix = lambda g: (lambda i: parts[i][g - bases[i] :])(int(np.searchsorted(bases, g, "right")) - 1)
    assert [suffix(g) for g in order] == sorted(suffix(g) for g in order) and len(order) == 300


def slow(rows, w):
    parts = [(t or "").encode() for _, t, _ in rows]
    out = []
    for (i, _, _), part, flags in zip(rows, parts, slow_repeated(parts, w)):
        gone = np.zeros(len(part) + 1, dtype=bool)
        for j in np.flatnonzero(flags):
            gone[j : j + w] = True
        gone = gone[: len(part)]
        kept = bytes(np.frombuffer(part, np.uint8)[~gone])
        out.append((i, len(part), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1, 1024])
def test_against_brute_force(spark, docs, rows, most):
    more = [(None, rows[0][1], "x"), (None, "no repeat at all " + "q" * 10, "x"), (60, "xyz" * 500, "y"), (61, "tail " + rows[9][1][-230:], "y"), (61, "other text with that id", "y")]
    wide = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("id", F.lit(1)).withColumn("th", F.lit("x")).withColumn("body", F.lit(2))
    out = suffixdedup.remove_repeats(wide, 200, most).collect()
    got = [(r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out]
    assert sorted(got, key=repr) == slow([*rows, *more], 200)


@pytest.mark.parametrize("levels", [0, 3])
def test_frequent_passage_in_many_contexts(spark, monkeypatch, levels):
    """A key with many different run texts is cut by other keys; windows partly in the passage repeat in some rows only."""
    monkeypatch.setattr(suffixdedup, "LEVELS", levels)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, tails = noise(230), [noise(40) for _ in range(4)]
    rows = [(i, noise(rng.randrange(50, 300)) + passage[: rng.choice([150, 205, 230])] + tails[i % 4][: rng.randrange(41)] + noise(60), "s") for i in range(60)]
    out = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, source string"), 200, 5).collect()
    got = [(r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out]
    assert sorted(got, key=repr) == slow(rows, 200)


def test_runs_of_a_key_meet_whatever_the_join(spark):
    """Some keys are crowded, some not; what joins them apart is made a broadcast join while the query runs."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [noise(420) for _ in range(12)]
    cut = lambda p: p[(a := rng.randrange(150)) : a + rng.randrange(205, 270)]
    rows = [(i, noise(30) + cut(passages[i % 12 if i < 60 else 0]) + noise(30) + cut(passages[(i // 12) % 12]), "s") for i in range(150)]
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        out = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8), 200, 8).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = [(r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out]
    assert sorted(got, key=repr) == slow(rows, 200)


def test_texts_are_exchanged_once(spark):
    """Also where keys are crowded: the bytes that all stages shuffle, beside those of the texts."""
    rng = random.Random(10)
    noise = lambda n: "".join(chr(rng.randrange(33, 126)) for _ in range(n))
    shared = noise(230)
    rows = [(i, noise(3000) + shared + noise(3000), "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).localCheckpoint()
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    out = suffixdedup.remove_repeats(docs, 200, 8).collect()
    assert all(sum(s.stop - s.start for s in r.spans) in range(230, 240) for r in out)
    assert shuffled() - before < 4.1 * sum(len(t) for _, t, _ in rows)  # 3.6; 4.6 if crowded keys exchange the texts again


def test_common_prefixes():
    rng = random.Random(5)
    data = bytes(rng.choice(b"ab\0") for _ in range(400))
    array = np.array(sorted(range(300), key=lambda g: data[g:]))
    slow_lcp = [0] + [next(k for k in range(31) if k == 30 or data[a + k] != data[b + k]) for a, b in zip(array[:-1], array[1:])]
    assert suffixes.common_prefixes(data, array, 30).tolist() == slow_lcp


def test_empty(nothing):
    assert suffixdedup.remove_repeats(nothing).count() == 0
