import ast
from pathlib import Path


def test_nothing_imports_the_llm_subpackage():
    root = Path(__file__).resolve().parent.parent / "threadloom"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("threadloom.llm") for n in names), path
