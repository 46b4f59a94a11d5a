"""The registered queries with and without the optional operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = """
import sys
sys.modules["corpus_pipeline"] = None
sys.modules["pubmart.llm"] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert "pipeline" not in names and not any(n.startswith("op1_") for n in names)
assert set(entry.oracle_sql()) <= names and len(names) > 150
"""


def test_entry_without_the_operators():
    subprocess.run([sys.executable, "-c", PROGRAM], cwd=ROOT, check=True, timeout=120)
