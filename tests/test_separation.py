"""The corpus operators are an optional part: nothing else imports them, and the entry module works without them."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "timberline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "timberline.llm" not in p.read_text(), p


def test_entry_without_them(tmp_path):
    shutil.copytree(ROOT / "timberline", tmp_path / "timberline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    assert said.stdout.strip().endswith("[]") and int(said.stdout.split()[0]) > 60
