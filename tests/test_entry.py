"""The driver contract holds with and without the optional subpackage."""

import sys

import __spark_entry__ as entry


def test_names_of_oracles_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_part(monkeypatch):
    for name in ("corpus_pipeline", "reviewloom.llm", "reviewloom.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    names = entry.queries()
    assert "side_share_report" in names and "pipeline" not in names
    assert not any(n.startswith("op1") for n in names)
