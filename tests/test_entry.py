import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 60
    assert all(callable(f) for f in names.values())
    for n in (1, 4, 5):
        assert f"p{n}_found" in names


def test_nothing_outside_imports_the_llm_package():
    for path in (ROOT / "waymark").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            inner = [a.name for a in node.names] if isinstance(node, ast.ImportFrom) and (node.level or node.module == "waymark") else []
            assert not any(n.startswith("waymark.llm") for n in names) and "llm" not in inner, path
