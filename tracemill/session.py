"""Sends this package to the executors, whose Python workers need it for vectorised functions."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tracemill-"), "tracemill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tracemill", os.path.relpath(full, root)))
    context.addPyFile(path)
    _sent.add(context.applicationId)


def work_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or one of its own where that is unset
    (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") + "/tracemill"
