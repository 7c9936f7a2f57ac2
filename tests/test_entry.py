"""The driver's contract, and that the engine stands without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _registered(folder, path):
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": str(path)} if path else {})
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True)


def test_imports_without_the_optional_parts(tmp_path):
    """A copy without both folders, whatever else is on the path of this process."""
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copytree(REPO / "scrivener", tmp_path / "scrivener", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = _registered(tmp_path, tmp_path)
    assert out.returncode == 0, out.stderr
    count, has_any = out.stdout.split()
    assert int(count) > 90 and has_any == "False"


def test_other_missing_modules_are_not_passed_over(tmp_path):
    """A module that the optional parts need, and that isn't theirs, must fail loudly."""
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copytree(REPO / "scrivener", tmp_path / "scrivener", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    assert "no_such_module_at_all" in _registered(tmp_path, None).stderr
