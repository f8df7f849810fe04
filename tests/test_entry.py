import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_nothing_else_imports_the_llm_folder():
    for path in (REPO / "sievecraft").rglob("*.py"):
        if "llm" not in path.parts:
            assert "sievecraft.llm" not in path.read_text(), path
