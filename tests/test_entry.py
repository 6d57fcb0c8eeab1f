"""The entry keeps every shop query when the optional subpackage is absent."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from vitrina.plans.registry import oracle_sql, queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as e
print(",".join(sorted(e.queries())))
print(",".join(sorted(e.oracle_sql())))
"""


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_imports_without_the_optional_folders(tmp_path, pipeline_too):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__") or (pipeline_too and n == "corpus_pipeline.py")])
    assert not (tree / "vitrina" / "llm").exists()
    assert (tree / "corpus_pipeline.py").exists() == (not pipeline_too and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")))
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tree, env={**os.environ, "PYTHONPATH": str(tree)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    found, sql = done.stdout.strip().splitlines()[-2:]
    assert found.split(",") == sorted(queries())
    assert sql.split(",") == sorted(oracle_sql())
