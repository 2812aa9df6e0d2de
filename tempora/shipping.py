"""The package's code for Python workers: a zip that Spark hands to every executor, so that workers need no path of the driver's."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        _sent.add(context.applicationId)
        here = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="tempora-code-"), "tempora.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(here.rglob("*.py")):
                out.write(p, p.relative_to(here.parent).as_posix())
        context.addPyFile(path)
    return spark
