"""The rest of the library without the training-data subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

HIDDEN = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['lorespring', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
names = set(e.queries())
assert 'bm25_search' in names and 'pipeline' not in names and not any(n.startswith('op') for n in names), names
assert set(e.oracle_sql()) <= names
"""


def test_imports_without_it():
    subprocess.run([sys.executable, "-c", HIDDEN], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_it():
    for path in (ROOT / "lorespring").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert ".llm" not in path.read_text() and "import llm" not in path.read_text(), path
