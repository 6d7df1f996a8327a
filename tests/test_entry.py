import importlib
import sys

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_other_folder(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("vellumdf.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "vellumdf.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    bare = importlib.import_module("__spark_entry__")
    assert bare.queries() and not [q for q in bare.queries() if q[0] == "p" and q[1:2].isdigit()]
