"""The registry with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from passagekit import plans

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "evidence", "n_sections"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())


def test_without_the_subpackage(tmp_path):
    """The rest imports and registers its queries when the folder and the pipeline are gone."""
    (tmp_path / "passagekit").mkdir()
    for p in (ROOT / "passagekit").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "passagekit" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) == len(plans.QUERIES)


def test_the_rest_passes_without_the_subpackage(tmp_path):
    """In a copy without both folders and the pipeline all other tests are found, and some of each kind pass."""
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", ".pytest_cache")
    for name in ("passagekit", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=skip)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=tmp_path, env=env, capture_output=True, text=True)
    found = run("--collect-only", "tests")
    assert found.returncode == 0, found.stdout
    some = run("tests/test_segmentation.py", "tests/test_models.py", "tests/test_entry.py::test_every_sql_has_a_query", "tests/test_queries.py::test_query_equals_sql[lists_sorted]")
    assert some.returncode == 0, some.stdout
