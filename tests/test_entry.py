"""The entry module, with and without the optional parts."""

import importlib
import importlib.abc
import sys

import pytest

import __spark_entry__
from postlane.plans import catalog


class Absent(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "postlane.llm") or name.startswith("postlane.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name="corpus_pipeline" if name == "corpus_pipeline" else "postlane.llm")


def test_every_catalog_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_optional_parts_may_be_absent(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("postlane.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(catalog.ORACLE_SQL)


def test_other_import_errors_are_not_hidden(monkeypatch):
    class Broken(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError("No module named 'something_else'", name="something_else")

    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Broken(), *sys.meta_path])
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id"]
