"""The training-data operators can be taken away."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield "." * node.level + (node.module or "")


def test_nothing_else_imports_llm():
    for path in (ROOT / "mistveil").rglob("*.py"):
        if "llm" not in path.parts:
            assert not [x for x in imported(path) if "llm" in x.split(".")], path


def test_entry_has_its_functions():
    import __spark_entry__ as e

    assert "sanitize_documents" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    frame = e.entry(spark)
    assert frame.columns == ["doc_id", "text", "n_spans"] and frame.count() == 200
