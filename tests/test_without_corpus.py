import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

CODE = """
import __spark_entry__ as entry
names = entry.queries()
assert names and not [n for n in names if n.startswith("op") or n == "pipeline"], sorted(names)
assert set(entry.oracle_sql()) <= set(names)
"""


@pytest.mark.parametrize("gone", [("folioscope/llm", "tests/llm"), ("folioscope/llm", "tests/llm", "corpus_pipeline.py")])
def test_engine_stands_alone(tmp_path, gone):
    """The entry module and the other tests load where the corpus operators are deleted, with the pipeline or without it."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    # what the outer interpreter finds, the inner one finds too, but for this repository
    inherited = [x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and os.path.realpath(x) != os.path.realpath(ROOT)]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(copy), *inherited])}
    for command in (["-c", CODE], ["-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"]):
        run = subprocess.run([sys.executable, *command], cwd=copy, env=env, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True)
        assert run.returncode == 0, run.stdout[-4000:]
