"""The package itself, sent to the Python workers: they need not have it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Once a context: add the package's source as a zip file. Called where functions for workers are made."""
    sc = (spark or SparkSession.active()).sparkContext
    if getattr(sc, "_sigloom_shipped", False):
        return
    home = tempfile.mkdtemp(prefix="sigloom-code-")
    atexit.register(shutil.rmtree, home, ignore_errors=True)
    here = Path(__file__).resolve().parent
    with zipfile.ZipFile(os.path.join(home, "sigloom_code.zip"), "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(os.path.join(home, "sigloom_code.zip"))
    sc._sigloom_shipped = True
