"""The driver's contract."""

import importlib.util

import __spark_entry__ as entry


def test_catalogue():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "lexicon_accuracy_wilson" in queries
    if importlib.util.find_spec("labelwright.llm"):
        assert sum(q.startswith("op") and q[2].isdigit() for q in queries) == 10


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for p in (root / "labelwright").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "labelwright.llm" not in p.read_text(), p
