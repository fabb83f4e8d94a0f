"""Sends the package to the executors, so that functions shipped by name can be imported there."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the Python path of all workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="pagegrid-"), "pagegrid.zip")
        with zipfile.ZipFile(path, "w") as packed:
            # sources only: nothing is compiled beside them, as the package may lie in a read-only folder
            for folder, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    source = os.path.join(folder, name)
                    with open(source, "rb") as text:
                        packed.writestr(os.path.relpath(source, os.path.dirname(package)), text.read())
        spark.sparkContext.addPyFile(path)
        _SENT.add(app)
    return spark
