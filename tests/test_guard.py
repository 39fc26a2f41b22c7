"""The rest must work without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'kv_latest' in q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "keyloom")):
        if os.path.basename(folder) != "llm":
            for name in (n for n in names if n.endswith(".py")):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), name


def test_a_broken_subpackage_is_not_passed_over(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    os.makedirs(tmp_path / "repo/keyloom/llm")
    (tmp_path / "repo/keyloom/llm/__init__.py").write_text("")
    (tmp_path / "repo/keyloom/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    (tmp_path / "repo/corpus_pipeline.py").write_text("")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert done.returncode and "a_module_that_is_not_there" in done.stderr
