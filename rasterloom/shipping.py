"""The package itself as a file that Spark hands to its Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a context.  The archive goes through Spark's own file server: no shared folder is needed."""
    sc = spark.sparkContext
    if getattr(sc, "_rasterloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="rasterloom-code-"), "rasterloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in sorted(os.walk(home)):
            for n in sorted(names):
                if n.endswith(".py"):
                    at = os.path.join(folder, n)
                    z.write(at, os.path.join("rasterloom", os.path.relpath(at, home)))
    sc.addPyFile(archive)
    sc._rasterloom_shipped = True
