"""The library without its part for training data: it imports, and its tests can be collected."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT


def _copy(to: str, *without: str) -> None:
    gone = {os.path.join(ROOT, w) for w in without}

    def ignore(folder: str, names: list[str]) -> list[str]:
        return [n for n in names if n in (".git", "__pycache__") or os.path.join(folder, n) in gone]

    shutil.copytree(ROOT, to, ignore=ignore)


def _run(folder: str, *command: str) -> str:
    done = subprocess.run([sys.executable, *command], cwd=folder, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stdout + done.stderr
    return done.stdout


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_training_data_part(tmp_path, pipeline):
    folder = str(tmp_path / "copy")
    _copy(folder, "headwater/llm", "tests/llm", *([] if pipeline else ["corpus_pipeline.py"]))
    names = _run(folder, "-c", "import __spark_entry__ as e; print(*e.queries())").split()
    assert "critical_tables" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]
    assert "test_oracle.py" in _run(folder, "-m", "pytest", "tests/", "--collect-only", "-q", "-p", "no:cacheprovider")


def test_an_empty_folder_counts_as_left_out(tmp_path):
    folder = str(tmp_path / "copy")
    _copy(folder, "headwater/llm", "tests/llm")
    os.makedirs(f"{folder}/headwater/llm")
    assert "pipeline" not in _run(folder, "-c", "import __spark_entry__ as e; print(*e.queries())").split()
