import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert "p5_found" in entry.queries()


def test_nothing_outside_the_subpackage_imports_it():
    for f in (ROOT / "dissimap").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("dissimap.llm") for n in names), f
