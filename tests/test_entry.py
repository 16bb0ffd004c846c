import importlib
import os
import sys

import pytest


def test_names_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_training_code(monkeypatch):
    """The entry module works where the training-data subpackage and the pipeline are gone."""
    for name in [m for m in sys.modules if m.startswith("matchlens.llm")] + ["corpus_pipeline", "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "matchlens.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "matchup_winrate" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
