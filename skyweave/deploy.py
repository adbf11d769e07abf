"""Send this package to the executors, for clusters whose Python workers don't have it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application, once for each; the driver serves them to every executor."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="skyweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors may ask for it until the driver ends
    path = os.path.join(folder, "skyweave.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for below, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(below, name)
                    z.write(full, os.path.join("skyweave", os.path.relpath(full, home)))
    context.addPyFile(path)
