"""The driver's entry points with and without the optional package."""

import os
import shutil
import subprocess
import sys
import zipfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_optional_package(tmp_path):
    for name in ("stormlens", "workload"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n[:2] == 'op' or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    env = {**os.environ, "PYTHONPATH": ""}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    n, has_ops, known = got.stdout.split()
    assert int(n) > 140 and has_ops == "False" and known == "True"


def test_package_is_shipped(spark, tmp_path, monkeypatch):
    from stormlens import session
    sent = []
    monkeypatch.setattr(spark.sparkContext, "addPyFile", sent.append)
    monkeypatch.setattr(spark, "_stormlens_shipped", False, raising=False)
    session.ship(spark)
    session.ship(spark)
    assert len(sent) == 1 and "stormlens/session.py" in zipfile.ZipFile(sent[0]).namelist()
