"""The driver's entry point in a fresh process, without a Spark session, with and without the training-data part."""

import json
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(root: str, code: str = CODE) -> tuple[set, set]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    a, b = json.loads(got.stdout)
    return set(a), set(b)


def test_queries_load_without_a_session():
    queries, oracles = names(ROOT)
    assert oracles <= queries and "event_triggered_average" in queries


@pytest.mark.parametrize("kept", [(), ("corpus_pipeline.py",)])
def test_without_the_training_data_part(tmp_path, kept):
    for part in ("tidemark", "__spark_entry__.py", *kept):
        at = os.path.join(ROOT, part)
        if os.path.isdir(at):
            shutil.copytree(at, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(at):
            shutil.copy(at, tmp_path / part)
    queries, oracles = names(str(tmp_path))
    assert queries and oracles <= queries and not [q for q in queries if q == "pipeline" or q.startswith("op")]


def test_without_a_library_of_the_training_data_part():
    blocked = "import sys; sys.modules['ahocorasick'] = None; " + CODE
    queries, _ = names(ROOT, blocked)
    assert queries and "pipeline" not in queries
