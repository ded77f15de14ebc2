"""The entry module stands without the optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
BLOCKED = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(tuple(sys.argv[1].split(","))):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = set(entry.queries())
assert names >= set(entry.oracle_sql()) and "accu_full" in names
assert not any(n.startswith("op") or n == "pipeline" for n in names)
"""


@pytest.mark.parametrize("gone", ["corpus_pipeline,truthloom.llm", "public_tokenizers", "zstandard"])
def test_entry_without_the_optional_parts(gone):
    done = subprocess.run([sys.executable, "-c", BLOCKED, gone], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
