"""The driver's three functions, and that the rest works without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_has_sql_or_a_reason():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries)
    assert {n for n in queries if n[0] == "q"} - set(oracle) == {"q49_logistic_cv", "q50_synth_dataset", "q87_models"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["user_id", "event_id", "click", "error", "signup", "view"] and out.count() > 0


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/tessera", f"{tmp_path}/tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert told.returncode == 0 and int(told.stdout.split()[-1]) >= 50
