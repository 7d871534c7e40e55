"""Sends the package to the executors of a session whose workers could not import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a py-file, unless workers find it by PYTHONPATH or their working directory."""
    found = {os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    app = spark.sparkContext.applicationId
    if str(ROOT) in found or app in _sent:
        return
    _sent.add(app)
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(ROOT / "starlode", f"{d}/tree/starlode", ignore=shutil.ignore_patterns("__pycache__"))
        for top in ROOT.glob("*_pipeline.py"):
            shutil.copy(top, f"{d}/tree/")
        # Executors fetch the file from the driver as they come, so it stays until the driver ends.
        kept = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, kept, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{kept}/starlode", "zip", f"{d}/tree"))
