"""Send this package to the Python workers of a session, wherever the session was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip file, once per application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parents[2]
    handle, name = tempfile.mkstemp(prefix="tidegrid-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in [*(root / "tidegrid").rglob("*.py"), *root.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(name)
    _sent.add(app)
