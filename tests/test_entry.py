import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_entry_and_names(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and set(rows[0].asDict()) == {"word", "rank"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_operators_for_training_data(tmp_path):
    for p in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / p, tmp_path / p)
    shutil.copytree(ROOT / "keyloom", tmp_path / "keyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import bench, __spark_entry__ as e; print(len(e.queries()), not any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "True" and int(out.stdout.split()[0]) >= 60


def test_a_missing_dependency_leaves_the_rest_and_is_said(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "keyloom", tmp_path / "keyloom", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-W", "default", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert int(out.stdout) >= 60 and "no_such_module" in out.stderr
