"""The driver's contract, also without the training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql_agree():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 40
    assert all(callable(f) for f in names.values())


def test_entry(spark):
    import __spark_entry__ as entry

    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0


def test_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert re.match(r"\d{2} \[\]", said.stdout)


def test_nothing_else_imports_the_subpackage():
    for folder, dirs, files in os.walk(os.path.join(ROOT, "corpusgrid")):
        dirs[:] = [d for d in dirs if d not in ("llm", "__pycache__")]
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "corpusgrid.llm" not in f.read(), name
