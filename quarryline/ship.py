"""Sends this package to the executors of a session, once, so that tasks can import it wherever the driver started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    home = Path(__file__).resolve().parent
    handle, target = tempfile.mkstemp(prefix="quarryline-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, str(Path(home.name) / p.relative_to(home)))
    spark.sparkContext.addPyFile(target)
