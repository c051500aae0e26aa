import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("gone", [(), ("orrery/llm",), ("orrery/llm", "corpus_pipeline.py")])
def test_queries_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
            (path / "__pycache__").mkdir(parents=True)
        path.unlink(missing_ok=True) if path.is_file() else None
    got = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    queries, sql, pipeline = got.stdout.split()
    assert int(queries) > 90 and int(sql) > 80 and pipeline == str(not gone and (ROOT / "orrery/llm").is_dir() and (ROOT / "corpus_pipeline.py").is_file())
