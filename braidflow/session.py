"""What a session needs before workers can run this package's functions."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to Python workers that don't have the repository on their path."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(root) not in on_path and app not in _sent:
        archive = Path(tempfile.mkdtemp(), "braidflow.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted((root / "braidflow").rglob("*.py")):
                z.write(p, p.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))
        _sent.add(app)
    return spark
