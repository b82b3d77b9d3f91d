"""Sessions for local use, and the package's code for executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine with settings that suit small tables."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lustrate")
    held = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"} | conf
    return builder.config(map=held).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp()), "lustrate.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
