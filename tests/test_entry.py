"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("left_out", [["llm"], ["llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_imports_without_optional_parts(tmp_path, left_out):
    shutil.copytree(f"{ROOT}/snapsift", tmp_path / "snapsift", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and out[2] == "False" and out[3] == "True"
    if "llm" in left_out:
        assert out[1] == "0"
