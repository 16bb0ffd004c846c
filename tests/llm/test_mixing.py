import re
from collections import defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from matchlens.llm import mixing


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, open_, fixed = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {**fixed, **share}
        fixed |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return fixed


def check(rows, out, block):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = slow_targets(dict(sizes))
    took = defaultdict(int)
    source = {i: s for i, _, s in rows}
    assert len(out) == len(rows)
    for r in out:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", next(t for i, t, _ in rows if i == r.doc_id) or ""))
        assert 0 <= r.taken <= 2 * r.size
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        took[s] += r.taken
    for s in sizes:
        assert abs(took[s] - want[s]) <= 1 + 0.01 * want[s], (s, took[s], want[s])


def test_targets_and_taken(docs, rows):
    for block in (7, 64, 2048):
        check(rows, mixing.taken(docs, block).collect(), block)


def test_reruns_agree_in_any_order(docs):
    key = lambda df: sorted((r.doc_id, r.taken) for r in df.collect())
    assert key(mixing.taken(docs)) == key(mixing.taken(docs.repartition(7, "text")))


def test_rows_of_the_mix(docs, rows):
    wide = docs.withColumn("size", F.lit(0)).withColumn("h", F.lit(1)).withColumn("mix_key", F.lit(1)).where("doc_id <> 31")
    took = {r.doc_id: (r.taken, r.size) for r in mixing.taken(wide.select("doc_id", "text", "source")).collect()}
    out = mixing.mixed(wide)
    assert out.columns == wide.columns
    got, texts = defaultdict(int), {i: t for i, t, _ in rows}
    for r in out.collect():
        assert r.text == texts[r.doc_id] or (texts[r.doc_id].split() or [""])[0] == r.text.split()[0]
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert {k: v for k, (v, _) in took.items() if v} == dict(got)


def test_schedule_is_spread(spark):
    plan = spark.createDataFrame([("a", 60_000, 90_000.0), ("b", 40_000, 30_000.0)], "source string, source_size long, target double")
    slots = mixing._schedule(plan, 10).orderBy("slot").collect()
    counts = [sum(s.source == "b" for s in slots[i : i + 100]) for i in range(0, 9000, 100)]
    assert min(counts) >= 22 and max(counts) <= 28


def test_mix_follows_the_schedule(spark, tmp_path):
    """In the order that rows are written, every stretch has the sources in about their shares."""
    rows = [(i, f"w{i} " * 20, "ab"[i % 4 == 0]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.source: r.target for r in mixing.mix(docs, 20)[1].collect()}
    mixing.mixed(docs, block_words=20).write.parquet(str(tmp_path / "mix"))
    parts = sorted((tmp_path / "mix").glob("*.parquet"))
    order = [s for p in parts for s in pq.read_table(p)["source"].to_pylist()]
    share = plan["b"] / sum(plan.values())
    for at in range(0, len(order) - 200, 200):
        assert abs(sum(s == "b" for s in order[at : at + 200]) - 200 * share) <= 12


def test_many_sources(spark):
    """Targets and schedule of more sources than a range has, against the plain rule."""
    sizes = {f"s{i:03}": (i * 37) % 91 + 1 for i in range(300)} | {None: 5000, "": 0}
    by = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = slow_targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in mixing.targets(by).collect())


def test_empty(nothing):
    assert mixing.taken(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_sizes_of_odd_texts(spark):
    texts = [None, "", " \t", "a", " a  b\n", "a" + " " * 300_000 + "b", "é\u3000x\x1cy z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r[0] for r in df.orderBy("doc_id").select(mixing.sizes(df)).collect()] == [0, 0, 0, 1, 2, 2, 2]
