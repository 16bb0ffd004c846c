import math
import random
import re
import textwrap

import pytest
import regex
from pyspark.sql import functions as F

from matchlens.llm import licenses

OTHERS = [f"the quick brown fox number {i} saw the river and the general public" for i in range(300)]


@pytest.fixture(scope="module")
def model():
    return licenses.train(OTHERS)


def wrapped(text, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(text, 72))


def slow_paragraphs(text):
    """Line by line: blank lines and sentences' ends close a paragraph."""
    out, now = [], []
    for line in (text or "").split("\n"):
        said = line.rstrip(" \t\x0b\x0c\r")
        if now and not line.strip(" \t\x0b\x0c\r#*/;%-"):
            out.append(now)
            now = []
            continue
        now.append(line)
        if said and (said[-1] in ".!?" or said[-1] in "\"')]" and said[-2:-1] and said[-2] in ".!?"):
            out.append(now)
            now = []
    parts = ["\n".join(p) for p in [*out, now] if p]
    return [p for p in parts if regex.search(r"[\p{L}\p{N}(©]", p) and not holder_only(p)]


def holder_only(p):
    m = regex.match(r"[^\p{L}\p{N}(©]*(copyright|©|\(c\))([^.\n]{0,120})\.?$", p, regex.I)
    return bool(m) and not regex.search("licen|reserved", m.group(2), regex.I)


def slow_words(text):
    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def slow_pairs(text):
    w = slow_words(text)
    return {" ".join(w[i : i + 2]) for i in range(len(w) - 1)}


def slow_scan(rows, model):
    """Paragraph by paragraph in plain Python, from the weights by gram."""
    weight = dict(zip(model.grams, model.weights))
    out = []
    for doc_id, text in rows:
        last = {}
        for k, part in enumerate(slow_paragraphs(text)):
            found = slow_pairs(part) | set(slow_words(part))
            z = [b / model.temperature for b in model.bias]
            hits = [weight[g] for g in found if g in weight]
            if not hits:
                continue
            for h in hits:
                z = [a + b / model.temperature for a, b in zip(z, h)]
            c = z.index(max(z))
            family = licenses.CLASSES[c]
            if family == "none":
                continue
            p = 1 / sum(math.exp(a - z[c]) for a in z)
            pairs, best, whole = slow_pairs(part), 0.0, 0.0
            for said in [*licenses.NAMES.get(family, []), *licenses.TEXTS.get(family, [])]:
                t = slow_pairs(said)
                best = max(best, len(t & pairs) / max(min(len(t), len(pairs)), 1))
                whole = max(whole, len(t & pairs) / max(len(pairs), 1) if len(t) >= licenses.LONG else 0.0)
            if best < licenses.OVERLAP or p < model.threshold and not (whole >= licenses.VERBATIM and len(pairs) >= licenses.LONG):
                family = "unknown"
            if family in last and out[last[family]][1] + out[last[family]][2] == k:
                row = out[last[family]]
                row[2:] = [row[2] + 1, family, row[4] + "\n" + part]
            else:
                last[family] = len(out)
                out.append([doc_id, k, 1, family, part])
    return sorted(map(tuple, out), key=str)


def shown(df):
    return sorted(((r.doc_id, r.paragraph, r.n_paragraphs, r.family, r.text) for r in df.collect()), key=str)


def test_naming_a_license_is_not_being_under_it(spark, model):
    """Sentences that name a family below the threshold are unknown, or no rows; a text's own passage is found all the same."""
    said = [
        "Our old client was licensed under Apache 2.0 but the new one is closed and may not be shared with anyone.",
        "Unlike the Apache license, this license forbids commercial use of any kind and the sharing of changes.",
        "Dual-licensed under MIT or Apache-2.0, at your choice.",
    ]
    long_ = max(licenses.TEXTS["apache-2.0"], key=len)
    rows = licenses.scan(spark.createDataFrame([*enumerate(said), (9, long_)], "doc_id long, text string"), model).collect()
    assert all(r.family == "unknown" or r.probability >= model.threshold for r in rows if r.doc_id < 9), rows
    assert [r.family for r in rows if r.doc_id == 9] == ["apache-2.0"]


def test_calibration_on_unseen_notices(model):
    assert model.unseen["accuracy"] > 0.5 and model.unseen["precision"] > 0.95 and model.unseen["calibration_error"] < 0.12
    assert model.unseen["accuracy_by_all"] > 0.5 and model.unseen["precision_by_all"] > 0.9 and model.unseen["calibration_error_by_all"] < 0.12


@pytest.mark.parametrize("left_out", ["mit", "apache-2.0", "bsd", "mpl-2.0", "isc"])
def test_families_left_out_are_not_taken_for_others(left_out):
    model = licenses.train(OTHERS, without=left_out)
    texts, known = [*licenses.TEXTS[left_out], *licenses.NOTICES[left_out]], licenses.templates()
    for text, p in zip(texts, model.probabilities(texts)):
        said = licenses.CLASSES[p.argmax()]
        assert said in ("none", "unknown") or p.max() < model.threshold or licenses.overlap_with(set(licenses.pairs_of(text)), known[said]) < licenses.OVERLAP


def test_a_wrapped_license_is_one_row(spark, model):
    for mark in ("", " * ", "# ", "// "):
        text = "\n".join([mark + "Copyright (c) 2020 Someone", mark, *[f"{wrapped(t, mark)}\n{mark}" for t in licenses.TEXTS["mit"]]])
        got = shown(licenses.scan(spark.createDataFrame([(1, text), (2, wrapped(licenses.TEXTS["mit"][0], mark))], "doc_id long, text string"), model))
        assert [(g[0], g[1], g[3]) for g in got] == [(1, 0, "mit"), (2, 0, "mit")], (mark, got)
        assert got[0][2] in (3, 4) and got[0][4].endswith("DEALINGS IN THE SOFTWARE.")  # 4: a line may end with a sentence


def test_families_lookalikes_and_unknown(spark, model):
    says = {"Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "x y. This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary", "Licensed under the Foo License, version 2.": "unknown"}
    rows = [(i, f"First line.\n{t}\nlast one") for i, t in enumerate(says)] + [(50 + i, t) for i, t in enumerate(licenses.LOOKALIKES)] + [(90, None), (91, ""), (92, "Released under the MIT License.\nReleased under the MIT License.")]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("words", F.lit("x")).withColumn("row", F.lit(1))
    got = [g[:4] for g in shown(licenses.scan(df, model))]
    assert got == sorted([*[(i, 1, 1, f) for i, f in enumerate(says.values())], (0, 1, 1, "mit"), (92, 0, 2, "mit")], key=str)


def test_equals_plain_python(spark, rows, model):
    rng, texts = random.Random(5), [t for f in licenses.NOTICES for t in [*licenses.TEXTS[f], *licenses.NOTICES[f]]] + licenses.UNKNOWN + licenses.LOOKALIKES
    some = [(i, t) for i, t, _ in rows] + [(None, "Released under the MIT License."), (7, "\n \n\t\nAll rights reserved.\n\n\n")]
    some += [(200 + i, t) for i, t in enumerate(texts)]
    for i in range(120):
        parts = [wrapped(rng.choice(texts), rng.choice(["", "# ", "  "])) for _ in range(rng.randint(1, 5))]
        some.append((400 + i, rng.choice(["\n", "\n\n", "\n \t\n\n", ".\n", "\n#\n"]).join(parts)))
    some.append((900, "word and the software " * 20_000 + "\n\n" + wrapped(licenses.TEXTS["bsd"][0]) + "\n" * 5_000 + " " * 50_000 + "\nLicense: MIT"))
    got = shown(licenses.scan(spark.createDataFrame(some, "doc_id long, text string"), model))
    assert got == slow_scan(some, model) and len({g[3] for g in got}) == 14


def test_native_and_empty(spark, docs, nothing, model):
    assert not re.search("Python|Pandas|Arrow", licenses.scan(docs, model)._jdf.queryExecution().executedPlan().toString())
    assert licenses.scan(nothing, model).count() == 0


@pytest.mark.skipif("not __import__('os').path.isdir('/root/testdata/sf0.01')")
def test_no_plain_paragraph_is_reported(spark):
    """The synthetic texts' licenses are whole lines of this kind, and all else, German with its "mit" too, is none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = licenses.scan(docs, licenses.train(licenses._others(docs, licenses.MAX_OTHERS))).collect()
    lines = [(r.doc_id, x) for r in docs.collect() for x in (r.text or "").split("\n") if re.search(r"licen[sc]ed? |license[,.]|rights reserved", x, re.I)]
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in lines) and not [r for r in out if r.family == "unknown"]
