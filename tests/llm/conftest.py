import random

import pytest


def words(rng, n):
    return [rng.choice(["alpha", "Beta", "gamma", "delta", "Epsilon", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(300)) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source): copies, near copies, shared lines and passages, empty, null and long texts, and a repeated row."""
    rng = random.Random(7)
    base = " ".join(words(rng, 120))
    near = base.replace(base.split()[60], "changed", 1)
    passage = " ".join(words(rng, 60))
    line = "This very long line is found in many of the documents here."
    out = [(1, base, "a"), (2, base, "a"), (3, near, "b"), (4, None, "b"), (5, "", None), (6, " \t\n ", "c"), (7, "one", "c"), (8, "é" * 150 + " ÀB ß", "c")]
    out += [(10 + i, " ".join(words(rng, 70)) + "\n" + (line if i % 2 else "  " + line.upper() + "\t") + "\n" + " ".join(words(rng, 30)) + (" " + passage if i % 3 == 0 else ""), "a" if i < 6 else "d") for i in range(9)]
    out += [(30, " ".join(words(rng, 40_000)), "a"), (31, "ab" * 400, "d"), (31, "ab" * 400, "d"), (32, "x y z " * 80, "d"), (33, "<|endoftext|> 　wide\x1c text", None)]
    return out


@pytest.fixture()
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
