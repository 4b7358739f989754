"""The entry point, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(entry.__file__)
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_flagship(spark):
    assert entry.entry(spark).count() == 5


def test_without_the_training_data_operators(tmp_path):
    for name in ("tessera", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    left = names(tmp_path)
    assert left and not any(n.startswith("op") or n == "pipeline" for n in left)
