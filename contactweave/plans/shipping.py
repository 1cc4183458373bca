"""Sends this package to the Python workers of a session that was not started with it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``contactweave`` importable in the workers, once per application.

    An installed package, or one on PYTHONPATH, works as well; then this only
    adds a copy.
    """
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="contactweave-code-"), "contactweave_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("contactweave", os.path.relpath(path, root)))
    context.addPyFile(archive)
    _SENT.add(context.applicationId)
