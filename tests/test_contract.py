"""The driver's entry module with and without the text subpackage."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.join(os.path.dirname(__file__), "..")
_BLOCKED = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {names}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len([n for n in e.queries() if n.startswith("op") or n == "pipeline"]), len(e.queries()))
"""


def _count(*names: str) -> tuple[int, int]:
    done = subprocess.run([sys.executable, "-c", _BLOCKED.format(names=set(names) or "()")],
                          cwd=ROOT, capture_output=True, text=True, check=True)
    return tuple(map(int, done.stdout.split()))


def test_entry_works_without_the_subpackage():
    alone = _count("rankloom.llm", "corpus_pipeline")
    assert alone[0] == 0 and alone[1] > 90
    assert _count("corpus_pipeline") == alone
