"""Making the package importable where its functions run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of the session's workers, once per application.

    A session that was started elsewhere need not have it on the workers' path; the driver serves the archive to all executors."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    if not (root / "kartei").is_dir():  # already inside an archive
        return
    folder = tempfile.mkdtemp(prefix="kartei-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "kartei.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "kartei").rglob("*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
