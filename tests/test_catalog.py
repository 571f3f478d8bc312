"""Every registered query has a name of its own, SQL names exist, and the entry runs."""

import sys

import __spark_entry__


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 120 and set(sql) <= set(queries)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_corpus_subpackage(monkeypatch):
    """The pipeline is built from the subpackage, so it goes with it; all other queries stay."""
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("dekadal.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "dekadal.llm", None)
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 120 and set(sql) <= set(queries)
    assert not [n for n in queries if n == "pipeline" or n.startswith("op")]
