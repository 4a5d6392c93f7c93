"""Make the package importable on Python workers, and name folders that all of them see."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, unless their import path has it already."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp(prefix="recallgrid-")) / "recallgrid_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "recallgrid").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before; a temporary folder can go without it
        if path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in ``spark.checkpoint.dir``; in local mode, where that is unset, in a temporary folder. What is in it goes when the driver ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = named.rstrip("/") if named else "file://" + tempfile.mkdtemp(prefix="recallgrid-")
    path = f"{own}/recallgrid-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path if named else own)
    return path
