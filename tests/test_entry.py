import sys

import __spark_entry__


def test_names_and_sql():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and {"p2_found", "p5_found", "sink_tsv"} <= set(q)


def test_core_does_not_need_the_text_problems(monkeypatch):
    monkeypatch.setitem(sys.modules, "glossaflow.llm.queries", None)
    assert "p2_found" in __spark_entry__.queries() and "p1_found" not in __spark_entry__.queries()
