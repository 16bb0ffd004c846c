import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

import numpy as np
from matchlens.llm import linededup
from matchlens.llm.cuckoo import CuckooFilter
from matchlens.llm.linededup import LineIndex, dedup_lines

STRIP = " \t\n\x0b\x0c\r"


def slow(rows, min_docs=5, min_chars=40):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(STRIP))
    held = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def digest(df):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect())


def test_against_brute_force(docs, rows):
    want = slow(rows)
    assert digest(dedup_lines(docs)) == want and sum(r[2] for r in want) > 3


def test_insert_and_delete_are_reversible(spark, docs, rows):
    first, rest = docs.where("doc_id < 14"), docs.where("doc_id >= 14")
    index = LineIndex.build(first, shards=3).insert(rest)
    assert digest(dedup_lines(docs, index)) == slow(rows)
    back = index.delete(rest.select("doc_id"))
    assert digest(dedup_lines(first, back)) == slow([r for r in rows if r[0] < 14])
    twice = index.insert(rest)
    assert digest(dedup_lines(docs, twice)) == slow(rows) and twice.refs.count() == index.refs.count()
    again = index.delete(spark.createDataFrame([(18,)], "doc_id long"))
    assert digest(dedup_lines(docs.where("doc_id <> 18"), again)) == slow([r for r in rows if r[0] != 18])


def test_filters_grow_with_the_keys(docs, rows, monkeypatch):
    monkeypatch.setattr(linededup, "LEAST_SHARDS", 1)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 1)
    index = LineIndex.build(docs.where("doc_id < 11"), min_docs=1)
    grown = index.insert(docs.where("doc_id >= 11"))
    assert grown.shards == grown.sized_for == grown.counts.count() == grown.refs.select("h1", "h2").distinct().count() > 1.5 * index.sized_for
    assert digest(dedup_lines(docs, grown)) == slow(rows, min_docs=1)


def test_filters_rule_out_and_shards_are_dealt(docs, rows, monkeypatch):
    monkeypatch.setattr(linededup, "SALT_ROWS", 1)
    index = LineIndex.build(docs)
    left = index.candidates(index.refs)
    repeated = index.counts.where("n_docs >= 5")
    assert left.count() < index.refs.count() / 2 and left.join(repeated, ["h1", "h2"]).count() == index.refs.join(repeated, ["h1", "h2"]).count() == 9
    assert digest(dedup_lines(docs, index)) == slow(rows)


def test_clashing_columns_nulls_and_empty(docs, nothing):
    wide = docs.withColumn("n_lines", F.lit("x")).withColumn("drop_id", F.lit(1)).withColumn("n_dropped", F.lit(None).cast("int"))
    out = dedup_lines(wide)
    assert out.columns == [*wide.columns, "n_lines_", "n_dropped_"] and out.count() == docs.count()
    assert out.where("doc_id = 4").first().text is None
    assert dedup_lines(nothing).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, 5000)
    f = CuckooFilter.sized(3000)  # too small on purpose: what doesn't fit is kept whole
    f.insert(keys)
    assert f.contains(keys).all()
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.05
    assert f.contains(rng.integers(1 << 62, (1 << 63) - 1, 5000)).mean() < 0.02
