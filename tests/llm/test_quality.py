import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.llm import quality


def slow(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)


def test_statistics(spark, docs, rows):
    more = [(50, "a b c a b c d\n#x\n#x\n \n", "a"), (51, "a a a a", "b"), (52, "x\x0by\x0cz 　q", "c")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("n_words", F.lit(1)).withColumn("w", F.lit(2))
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.statistics(docs).collect())
    assert got == sorted((i, *slow(t)) for i, t, _ in [*rows, *more])


def test_native_plan(docs):
    plan = quality.judged(docs, quality.DecisionList((quality.Rule((("symbols", ">", 0.1),)),)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_learns_planted_rules_and_holds_out():
    rng = np.random.default_rng(4)
    x = {k: rng.random(3000) for k in ("symbols", "upper", "repeats", "digits")}
    low = ((x["symbols"] > 0.8) & (x["upper"] <= 0.5)) | (x["repeats"] > 0.9)
    first = {k: v[:2000] for k, v in x.items()}
    rules = quality.learn(first, low[:2000])
    rest = {k: v[2000:] for k, v in x.items()}
    assert (rules.good(rest) == ~low[2000:]).mean() > 0.97
    assert quality.learn(first, np.zeros(2000, bool)).rules == () == quality.learn(first, np.ones(2000, bool)).rules


def test_expression_equals_the_list(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.random()) for _ in range(200)]
    rules = quality.DecisionList((quality.Rule((("a", ">", 0.6), ("b", "<=", 0.5))), quality.Rule((("b", ">", 0.9),))))
    got = [r.good for r in spark.createDataFrame(rows, "a double, b double").select(rules.column().alias("good")).collect()]
    assert got == rules.good({"a": np.array([r[0] for r in rows]), "b": np.array([r[1] for r in rows])}).tolist()


def test_keep_good_keeps_columns_and_clean_rows(spark, docs, rows):
    wide = docs.withColumn("whole_row", F.lit(1)).withColumn("kept", F.lit(False)).withColumn("a.b", F.lit(2))
    out = quality.keep_good(wide, quality.DecisionList(()))
    assert out.columns == wide.columns
    fine = lambda s: s[0] >= 50 and 100 * s[4] <= 50 * s[0]
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, t, _ in rows if fine(slow(t)))


def test_without_labels_or_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    assert quality.learned(docs, labels).rules == ()
    assert quality.judged(nothing, quality.learned(nothing, labels)).count() == 0


@pytest.mark.skipif("not __import__('os').path.isdir('/root/testdata/sf0.1')")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learned(docs, labels.where("doc_id % 2 = 0"))
    out = quality.judged(docs, rules).join(labels.where("doc_id % 2 = 1 and quality = 1"), "doc_id").where("not base_failed")
    assert out.where("kept").count() / out.count() > 0.97
    low = quality.judged(docs, rules).join(labels.where("doc_id % 2 = 1 and quality = 0"), "doc_id").where("not base_failed")
    assert low.count() > 100 and low.where("not kept").count() / low.count() > 0.95 and len(rules.rules) > 0
