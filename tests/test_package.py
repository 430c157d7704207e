"""The order jobs stand alone: nothing outside the corpus subpackage imports it, and all imports work without it."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_imports_the_corpus_subpackage():
    for path in (ROOT / "orderlens").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


def test_entry_hides_no_other_missing_package():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    there = (ROOT / "corpus_pipeline.py").exists() and (ROOT / "orderlens" / "llm").is_dir()
    assert done.returncode and "zstandard" in done.stderr or not there


def test_entry_imports_without_it():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
