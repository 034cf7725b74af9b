"""Sessions, and this package's code on executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[int] = set()


def session(app: str = "passagework", **conf: str) -> SparkSession:
    """A session with the settings that the plans count on: adaptive execution with skew joins, UTC."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once a context, so that its functions can be unpickled there."""
    context = spark.sparkContext
    if id(context) not in _shipped:
        _shipped.add(id(context))
        if str(PACKAGE.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
            path = Path(tempfile.mkdtemp()) / "passagework.zip"
            with zipfile.ZipFile(path, "w") as out:
                for file in sorted(PACKAGE.rglob("*.py")):
                    out.write(file, file.relative_to(PACKAGE.parent))
            context.addPyFile(str(path))
    return spark
