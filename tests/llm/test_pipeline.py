"""The stages on the driver's tables, and each on its predecessor's rows against a brute-force version."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.llm import packing, quality

from test_jaccard import slow_components
from test_mixing import slow_targets
from test_quality import slow as slow_statistics

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables of clean, copied, nearly copied and junk documents, shared lines, nulls, ties, repeated rows, a very long text."""
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + "".join(rng.choice("klmnopqrst") for _ in range(rng.randrange(2, 7)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n // 12))
    line = "A line of more than forty characters that is in many of them."
    rows = [(i, prose(rng.choice([72, 120, 240])) + ("\n" + line if i % 3 == 0 else ""), "ab"[i % 2] if i % 7 else None) for i in range(40)]
    rows += [(100 + i, t, s) for i, (_, t, s) in enumerate(rows[:6])]
    rows += [(120 + i, t.replace(" ", " changed ", 1), s) for i, (_, t, s) in enumerate(rows[6:12])]
    rows += [(200 + i, " ".join(word() + "$$$#" for _ in range(80)), "b") for i in range(20)]
    rows += [(300, None, "a"), (301, "", "a"), (302, "too short", None), (303, prose(60_000), "c"), (304, "x y z " * 60, "c"), (5, rows[5][1], rows[5][2]), (None, prose(120), "a")]
    rows += [(305, rows[30][1].upper(), "c"), (306, "<|endoftext|> " + prose(120), "c")]
    top = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en" if i else None, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"size": F.lit(1), "fp": F.lit("x"), "n_lines": F.lit(2), "h": F.array(F.lit(1))})  # names that the stages use inside
    docs.write.parquet(f"{top}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 40)] + [(200 + i, 0, 0) for i in range(20)] + [(300, None, 0), (None, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def listed(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def slow_lines(rows, min_docs=5, min_chars=40):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    last = {k: max(v, key=lambda x: (x is not None, x or 0)) for k, v in held.items() if len(v) >= min_docs}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if key(x) not in last or last[key(x)] == i), *rest) for i, t, *rest in rows]


def test_each_stage_against_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = listed(docs)
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        columns, at[name] = docs.columns, spark.read.parquet(str(tmp_path / name))
        docs = at[name]
        assert docs.columns == columns or name == "best_fit_packing"
    counted = lambda rs: sorted(((i, t, la, s, len(t or "")) for i, t, la, s, _ in rs), key=repr)

    # The list is learned from the labels; its statistics are written once more in test_quality.
    rules = quality.learned(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    assert rules.rules and set(rules.features()) <= {"n_words", "mean_word", "symbols", "dup_lines", "repeats"}

    def good(text):
        n, chars, symbols, dup, repeated = slow_statistics(text)
        if n < 50 or 100 * repeated > 50 * n:
            return False
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        x = {"n_words": n, "mean_word": chars / n, "symbols": symbols / chars, "dup_lines": dup / len(lines), "repeats": repeated / n}
        return bool(rules.good({k: np.array([float(v)]) for k, v in x.items()})[0])

    rows = [r for r in rows if good(r[1])]
    assert listed(at["quality_rules"]) == rows and not any(200 <= (r[0] or 0) < 220 for r in rows) and {r[0] for r in rows} >= set(range(40)) | {303, None}
    rows = counted(slow_lines(rows))
    assert listed(at["line_dedup"]) == rows
    known = [r for r in rows if r[0] is not None]
    root = slow_components(sorted({(r[0], r[1]) for r in known}))
    kept = {r[0]: r for r in known if root[r[0]] == r[0]}
    rows = sorted([*kept.values(), *[r for r in rows if r[0] is None]], key=repr)
    assert listed(at["simhash_near_dedup"]) == rows and not any(100 <= (r[0] or 0) < 130 for r in rows)

    sizes, took, whole = defaultdict(int), defaultdict(int), {(r[0], r[3]): r[1] for r in rows}
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1]))
    mix = listed(at["mix_sources"])
    for i, t, _, s, n in mix:
        source = whole[(i, s)]
        assert n == len(t) and (t == source or t == " ".join(WORD.findall(source)[: len(WORD.findall(t))]))
        took[s] += len(WORD.findall(t))
    want = slow_targets(dict(sizes))
    assert all(abs(took[s] - want[s]) <= 1 + 0.01 * want[s] for s in sizes) and max(Counter((r[0], r[3]) for r in mix).values()) <= 2

    encode, pieces = packing.byte_bpe(), Counter()
    for i, t, *_ in mix:
        ids = [*encode(t or ""), 2]
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a : first if k == 0 else a + 1024]
            pieces[(i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    packed = at["best_fit_packing"].collect()
    of = lambda rs: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert of(packed) == pieces
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [a for a, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_empty_documents(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
