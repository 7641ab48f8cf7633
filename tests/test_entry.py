"""The entry works without the corpus operators, or without a library that they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
HIDE = """
import sys
sys.path.insert(0, {root!r})
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
queries = entry.queries()
assert "daily_sales" in queries and entry.oracle_sql().keys() <= queries.keys()
print(sorted(n for n in queries if n.startswith("op") or n == "pipeline"))
"""


@pytest.mark.parametrize("names", [("zstandard",), ("orderloom.llm",), ("public_tokenizers", "regex")])
def test_without(names):
    code = HIDE.format(root=ROOT, names=names)
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=100)
    assert found.returncode == 0, found.stderr
    # The pipeline writes no archives.
    assert found.stdout.strip() == ("['pipeline']" if names == ("zstandard",) else "[]")
