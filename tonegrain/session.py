"""Session set-up shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators count on.

    On a cluster leave ``master`` out and let spark-submit name it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites of column expressions cost a stack walk each.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return pin(builder.getOrCreate())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers of an application, once, so that they need neither an install nor its folder.

    Spark serves the archive from the driver; no executor reads the driver's folders.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp(prefix="tonegrain-package-"))
        archive = folder / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark


def pin(spark: SparkSession) -> SparkSession:
    """Fix the one runtime setting that changes results: the session time zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
