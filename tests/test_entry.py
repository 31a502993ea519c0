"""The contract file: importable, every SQL belongs to a query, the flagship query runs."""

import __spark_entry__ as e


def test_contract(spark):
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values())
    assert e.entry(spark).count() > 0


def test_nothing_needs_the_corpus_operators():
    from pathlib import Path

    root = Path(e.__file__).parent / "seriesforge"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f
