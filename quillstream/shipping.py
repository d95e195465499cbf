"""Makes the package importable by Python workers wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package's source to the executors through Spark's own file server, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix=f"{root.name}-")
    atexit.register(shutil.rmtree, folder, True)  # Spark serves the file from here as long as the driver lives
    packed = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(packed))
    _shipped.add(app)
