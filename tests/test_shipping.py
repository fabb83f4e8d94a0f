"""Workers import the package from what the driver sends, not from the working directory."""
import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as contract
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", contract.queries()["x02_list_rows"](spark, sys.argv[2]).count())
"""


def test_query_from_another_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, repo, "/root/testdata/sf0.001"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_package_is_sent_as_sources(spark, tmp_path, monkeypatch):
    import shutil
    import zipfile

    from pagegrid.plans import shipping

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    package = shutil.copytree(f"{repo}/pagegrid", tmp_path / "pagegrid", ignore=shutil.ignore_patterns("__pycache__"))
    sent = []
    monkeypatch.setattr(shipping, "__file__", str(package / "plans" / "shipping.py"))
    monkeypatch.setattr(shipping, "_SENT", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    shipping.ship(spark)
    names = zipfile.ZipFile(sent[0]).namelist()
    assert "pagegrid/plans/shipping.py" in names and all(n.endswith(".py") for n in names)
    assert not list(package.rglob("*.pyc"))  # nothing is written into the package's folder


def test_release_deletes_checkpoints(spark):
    from pagegrid.plans import lineage

    kept = lineage.cut(spark.range(10))
    written = [path for _, path in lineage._STAGED if "rdd-" in path]
    assert kept.count() == 10 and written and os.path.exists(written[-1].removeprefix("file:"))
    lineage.release()
    assert not any(os.path.exists(p.removeprefix("file:")) for p in written)
