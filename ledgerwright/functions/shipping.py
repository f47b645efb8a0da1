"""How executors come by this package where it is not installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Set on a context that has been given the package, by whatever part of it came first.
SHIPPED = "_ledgerwright_shipped"


def ship(spark: SparkSession) -> None:
    """Give executors the package once per application, for functions that run in Python there."""
    context = spark.sparkContext
    if getattr(context, SHIPPED, False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="ship")  # the driver's own; Spark hands the file out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    context.addPyFile(target)
    setattr(context, SHIPPED, True)
