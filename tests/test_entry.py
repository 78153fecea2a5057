"""The entry works with and without the optional subpackage."""

import importlib
import sys

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_parts(monkeypatch):
    for name in [n for n in sys.modules if n.split(".")[:2] == ["kinweave", "llm"]]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "kinweave.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(entry)
        assert "friends_of_friends" in bare.queries()
        assert not any(name.startswith("op") or name == "pipeline" for name in bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
