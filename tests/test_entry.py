"""The driver's contract holds with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_training_data_operators(tmp_path, pipeline):
    if pipeline:
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    shutil.copytree(f"{ROOT}/skeinlake", tmp_path / "skeinlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1:] == ["False", "False"] and int(out.stdout.split()[0]) > 70
