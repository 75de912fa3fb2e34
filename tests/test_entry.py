"""The driver's contract, with and without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("gone", [["corpus_pipeline.py"], ["siltstone/llm", "corpus_pipeline.py"], ["siltstone/llm"]])
def test_queries_without_parts_of_the_repository(tmp_path, gone):
    shutil.copytree(ROOT / "siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e, siltstone; q = set(e.queries()); print(len(q), set(e.oracle_sql()) <= q, 'pipeline' in q, any(n.startswith('op1_') for n in q), e.__file__, siltstone.__file__)"
    # what the copy lacks must not be found in the repository itself
    path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not Path(p).resolve().is_relative_to(ROOT)]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), *path])}
    *out, entry, package = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert Path(entry).is_relative_to(tmp_path) and Path(package).is_relative_to(tmp_path)
    there = (ROOT / "siltstone/llm").is_dir() and "siltstone/llm" not in gone
    assert int(out[0]) >= 90 and out[1:] == ["True", "False", str(there)]
