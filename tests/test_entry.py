"""The driver's contract holds without the corpus subpackage and its pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
SAYS = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op') and k[2].isdigit() for k in q), sorted(e.oracle_sql().keys() - q.keys()))"


def run(folder: Path) -> list[str]:
    env = {**os.environ, "PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", SAYS], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split(maxsplit=3)


def copy(to: Path, *without: str) -> Path:
    skip = shutil.ignore_patterns(".git", "__pycache__", *without)
    shutil.copytree(ROOT, to, ignore=skip)
    return to


def test_without_the_subpackage(tmp_path):
    n, pipeline, corpus, odd = run(copy(tmp_path / "a", "llm"))
    assert int(n) > 90 and (pipeline, corpus, odd.strip()) == ("False", "False", "[]")


def test_without_the_subpackage_and_the_pipeline(tmp_path):
    n, pipeline, corpus, odd = run(copy(tmp_path / "a", "llm", "corpus_pipeline.py"))
    assert int(n) > 90 and (pipeline, corpus, odd.strip()) == ("False", "False", "[]")
