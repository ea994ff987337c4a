"""The entry points with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import __spark_entry__
from filigree.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_points_name_the_same_queries():
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _names(folder, *without):
    shutil.copytree(os.path.join(ROOT, "filigree"), folder / "filigree", ignore=shutil.ignore_patterns("__pycache__", *[w for w in without if "." not in w]))
    for file in ("__spark_entry__.py", "corpus_pipeline.py"):
        if file not in without and os.path.exists(os.path.join(ROOT, file)):
            shutil.copy(os.path.join(ROOT, file), folder / file)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(p for p in sys.path if p and os.path.abspath(p) != ROOT)}
    return set(subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split())


def test_library_stands_without_training_data_part(tmp_path):
    for k, without in enumerate((("llm", "corpus_pipeline.py"), ("llm",))):
        folder = tmp_path / str(k)
        folder.mkdir()
        assert _names(folder, *without) == set(registry.QUERIES)
