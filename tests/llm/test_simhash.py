import re

import pytest
import xxhash
from pyspark.sql import functions as F

from matchlens.llm import simhash
from matchlens.llm.components import connected_components


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_fingerprints_and_components(docs, rows):
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [(i, slow_fingerprint(t)) for i, t, _ in rows]
    assert sorted((a, b) for a, b, _ in got) == sorted(prints)
    want = components([(a, b) for a, f in prints for b, g in prints if bin(f ^ g).count("1") <= 2])
    assert all(want[a] == c for a, _, c in got)


@pytest.mark.parametrize("radius", [0, 1, 2])
@pytest.mark.parametrize("most", [1, 1000])
def test_links_of_crowded_buckets(spark, radius, most):
    """Fingerprints around one another, so that buckets are crowded: all pairs, however often buckets are dealt again."""
    values = [0] + [1 << i for i in range(30)] + [(1 << i) | (1 << (i + 7)) for i in range(40)] + [7 << i for i in range(0, 60, 5)] + [0x7FFFFFFFFFFFFFFF]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), radius, most).collect()
    differ = lambda a, b: bin((a ^ b) % (1 << 64)).count("1")
    assert {(r.a, r.b) for r in links} == {(a, b) for a in values for b in values if a < b and differ(a, b) <= radius}


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_drop_keeps_one_of_each(spark, docs, rows):
    wide = docs.withColumn("kept_id", F.lit(1)).withColumn("fp", F.lit("x")).unionByName(spark.createDataFrame([(None, "no id here", "a", 1, "x")], "doc_id long, text string, source string, kept_id int, fp string"))
    out = simhash.drop_near_duplicates(wide)
    assert out.columns == wide.columns
    ids = [r.doc_id for r in out.collect()]
    prints = {i: slow_fingerprint(t) for i, t, _ in rows}
    want = components([(a, b) for a, f in prints.items() for b, g in prints.items() if bin(f ^ g).count("1") <= 2])
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.drop_near_duplicates(nothing).count() == 0
