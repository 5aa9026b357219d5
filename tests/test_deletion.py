"""The engine without the training-data operators: their folders and the pipeline may be deleted, or be there and not importable."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert "keyword_search_topk" in names and "cover_density_topk" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names, names
assert set(e.oracle_sql()) <= names
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0 and e.queries()["edition_as_of"](spark, e.SMOKE_DIR).count() > 0
"""


def copied(at):
    shutil.copytree(ROOT / "lorebase", at / "lorebase", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, at)


@pytest.mark.parametrize("how", ["deleted", "empty", "broken"])
def test_the_rest_runs_without_the_operators(tmp_path, how):
    copied(tmp_path)
    folder = tmp_path / "lorebase" / "llm"
    shutil.rmtree(folder, ignore_errors=True)
    if how == "deleted":
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    else:
        folder.mkdir()
    if how == "broken":
        (folder / "__init__.py").write_text("import a_module_that_is_not_there\n")
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_imports_the_operators():
    for file in (ROOT / "lorebase").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "lorebase.llm" not in file.read_text() and "from lorebase import llm" not in file.read_text(), file
