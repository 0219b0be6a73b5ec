"""What the driver reads: queries, their SQL, and the guard around the optional subpackage."""

import importlib
import sys

import __spark_entry__ as entry_module
from concourse.plans import load_all


def test_every_sql_has_a_query():
    names = set(entry_module.queries())
    assert set(load_all()) <= names
    assert set(entry_module.oracle_sql()) <= names


def test_missing_subpackage_leaves_the_other_queries(monkeypatch):
    def gone(name, package=None):
        if name.startswith("concourse.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return importlib.import_module(name, package)

    monkeypatch.setattr(sys.modules["__spark_entry__"], "import_module", gone)
    assert set(entry_module.queries()) == set(load_all())
    assert set(entry_module.oracle_sql()) <= set(load_all())
