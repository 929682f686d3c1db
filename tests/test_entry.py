import builtins
import importlib
import sys

import pytest

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators(monkeypatch):
    real = builtins.__import__

    def gone(name, *args, **more):
        if name == "corpus_pipeline" or name.startswith("weftline.llm"):
            raise ModuleNotFoundError(f"No module named '{name}'", name=name)
        return real(name, *args, **more)

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("weftline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", gone)
    entry = importlib.reload(__spark_entry__)
    names = entry.queries()
    assert "single_link" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert "pipeline" not in names and set(entry.oracle_sql()) <= set(names)


def test_other_import_errors_are_not_swallowed(monkeypatch):
    real = builtins.__import__

    def broken(name, *args, **more):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'numpy'", name="numpy")
        return real(name, *args, **more)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()
